"""Garbled text from a wrong character encoding: found, and restored by round-trip repair.

A text garbled by reading bytes in encoding R though they were written in W turns back by encoding it in R and
decoding the bytes strictly in W.  The operator tries candidate pairs on every passage, repeats for nested
layers, and accepts a repair only where a garbling cost drops.  The cost of a passage is the surprise of its
adjacent character pairs (those with a character beyond ASCII), learnt over all documents of the corpus as
the share of documents that hold a pair (copies of one text are one document, and passages that turn
back as a whole by a strict UTF-8 round trip don't count at all), plus a fixed amount for marks that sound text doesn't have (Latin
within Cyrillic words, capitals after small letters, frame signs or control codes between letters).

Pass 1 brings copies of one text together (a shuffle of the texts beyond ASCII, combined in each task first) and
aggregates pair shares.  Only pairs in at least ``KNOWN`` of all documents (and ``LEAST`` documents) are kept, at most
(pairs per document) / KNOWN rows, whatever the corpus; more than ``MOST_KNOWN`` raise before they are sent anywhere.
Pass 2 is a scan.  In both, a kernel lays many texts end to end as one array of code points; array operations
find the sentences that any repair could touch (a doubtful pair, a mark, the bytes of a UTF-8 character in one of the
encodings), and only these are looked at one by one.  What was made of a word is remembered.

Every find has its routes: ``utf-8`` (bytes of UTF-8 read in another encoding, strictly decoded), ``in part`` (the same, but
bytes beside the restored characters don't decode), ``single-byte`` and ``wide`` (strict round trips between legacy
encodings), ``entities`` (written as numbers after garbling), ``lost bytes`` (characters put back of which
only the visible bytes were left: the one route that isn't a round trip), ``replacement`` (U+FFFD, not restored).
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.names import free_name

# What the corpus is known to use.
KNOWN = 2e-4  # share of documents from which on a pair counts as known
LEAST = 3  # documents that hold a known pair, at least: one garbled text, filed twice, must not vouch for itself
FEW = 200  # of fewer different texts than these, copies count as up to LEAST documents, for little else can vouch
MOST_KNOWN = 8_000_000  # known pairs and words that workers can hold; more raise
WORD_LEAST = 3  # characters of a known word, at least: shorter ones vouch for nothing

# Costs are surprises in nats: a pair in one of e ** 6 = 400 documents costs 6.
_UNKNOWN_COST = -math.log(KNOWN) + 0.5  # a little more than the rarest known pair
_RARE_COST = 6.0  # from here on a pair is doubtful
_MARK_COST = 3.0  # of a mark that sound text doesn't have, besides its pair

# How far a cost must drop.  Fitted by eye on samples of the test tables; a higher one finds less and errs less.
_LAYER_DROP = 1.5  # one layer of a word: about one known pair less
_WORD_DROP = 3.0  # a word through all its layers: 20 times likelier
_SURE_WORD_DROP = 12.0  # a word whose repair brings marks in
_LOST_DROP = 6.0  # a character put back: 400 times likelier, for this isn't a round trip
_SENTENCE_DROP = 8.0  # a sentence between legacy encodings, which any sound text can be changed by
_SHORT_SENTENCE_DROP = 11.0  # the same where less of the cost goes, with two doubtful pairs at least
_SENTENCE_SHARES = (0.45, 0.70, 0.75)  # of the cost may be left: plainly, with a short drop, where marks go
_MANY_RARE = 4  # doubtful pairs from which on multi-byte encodings are tried
_STRICT = 2  # characters that a strict round trip of a passage gives, at least, for the passage not to count as sound
_LONG = 4  # and for it to be taken whatever characters the corpus is known to use
_REMEMBERED = 200_000  # words
_SLICE = 1 << 20  # characters laid end to end at a time, or one text if that is longer

# The candidate encodings.
READ_AS = ("cp1252", "latin-1", "cp1250", "cp1251", "cp437", "cp850", "cp852", "cp866", "mac_roman", "koi8_r", "iso8859_2", "iso8859_5", "iso8859_15")
READ_AS_WIDE = ("gbk", "cp932", "big5")
WRITTEN = ("cp1252", "cp1250", "cp1251", "koi8_r", "mac_roman", "cp850", "cp437", "cp866", "iso8859_2", "iso8859_5", "cp852")
WRITTEN_WIDE = ("cp932", "euc_jp", "gbk")

_SPLIT_PAIRS = re.compile(r"(?=([^\x00-\x7f].|.[^\x00-\x7f]))", re.DOTALL)
_UTF8 = re.compile(rb"(?:[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2})+")
_UTF8_CHARACTERS = re.compile(_UTF8.pattern.decode("ascii"))  # the same over characters that stand for bytes
# Marks, as classes of the two characters of a pair (left, right); a control code from 0x80 to 0x9F is one as well.
_MARK_PAIRS = (
    ("A-Za-zÀ-ɏ", "Ѐ-ӿ"), ("Ѐ-ӿ", "A-Za-zÀ-ɏ"), ("a-z", "Ͱ-Ͽ"), ("Ͱ-Ͽ", "a-z"), ("a-zß-öø-ÿ", "À-ÖØ-ÞŠŽŒŸ"), ("а-џ", "А-ЯЁ"),
    ("A-Za-zЀ-ӿ", "¡-´¶-¿×÷†-•‰‹›™ˆ˜∀-⋿─-◿⌐ﬁﬂ"), ("¤-´¶¹¼-¾†‡‰∀-⋿─-◿⌐ﬁﬂ", "A-Za-zЀ-ӿ"), ("Ѐ-ӿ", "µ"), ("µ", "Ѐ-ӿ"),
)
_BEYOND = re.compile(r"[^\x00-\x7f]")
_TWO_BYTES = re.compile(r"[^\x00-\x7f\u2e80-\U0010ffff]{2}")  # no single-byte encoding has characters from U+2E80 but two ligatures
_RUNS = re.compile("[\x20-\x7e\x80-\xff]+")
_ALONE = re.compile(r"(?<![^\x00-\x7f])[^\x00-\x7f](?![^\x00-\x7f])")
_SENTENCE = re.compile(r"[^.!?\n]*[^\x00-\x7f][^.!?\n]*[.!?]?")
_EDGES = ".,;:!?()"
_WIDE_FROM = 0x2E80  # from here on lie the characters that bytes of UTF-8 become in multi-byte encodings
_BLANKS = (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
_POINTS = 0x110000
_ENTITY = re.compile(r"&#(\d{2,6});")


def _byte_table(encoding: str) -> dict[str, int]:
    """Character to byte; bytes without a character stand for the control code of their number."""
    table: dict[str, int] = {}
    for b in range(128, 256):
        try:
            c = bytes([b]).decode(encoding)
        except UnicodeDecodeError:
            c = chr(b)
        table.setdefault(c, b)
    return table


def _small_letters(table: dict[str, int]) -> dict[str, int]:
    """The table of a text that was put into small letters after it was garbled."""
    lowered = {c.lower(): b for c, b in table.items() if len(c.lower()) == 1 and c.lower() != c}
    return {**table, **lowered}


def _strict_tables() -> list[tuple[frozenset[str], frozenset[str], dict[int, int]]]:
    """By encoding: characters of leading bytes, of continuing ones, and the map to bytes (beyond 255: no such byte)."""
    out = []
    for table in map(_byte_table, READ_AS):
        change = {b: 0xFFFF for b in range(128, 256)} | {ord(c): b for c, b in table.items()}
        out.append((frozenset(c for c, b in table.items() if 0xC2 <= b <= 0xF4), frozenset(c for c, b in table.items() if b <= 0xBF), change))
    return out


_STRICT_TABLES = _strict_tables()


def strict_round_trips(passage: str, least: int) -> list[str]:
    """What the passage turns back into where all its characters beyond ASCII are UTF-8 bytes read in one encoding,
    and at least ``least`` characters come of it."""
    m = _BEYOND.search(passage)
    if m is None or _ALONE.search(passage):
        return []
    first, second = passage[m.start() : m.start() + 2]
    out = []
    for lead, tail, change in _STRICT_TABLES:
        if first in lead and second in tail:
            try:
                y = passage.translate(change).encode("latin-1").decode("utf-8")
            except UnicodeError:
                continue
            if len(_BEYOND.findall(y)) >= least and y not in out:
                out.append(y)
    return out


class _Reader:
    """One encoding that UTF-8 bytes may have been read in."""

    def __init__(self, name: str, table: dict[str, int]):
        self.name, self.table = name, table
        self.as_bytes = _Bytewise((ord(c), b) for c, b in table.items())

    def repair(self, word: str) -> str | None:
        out, at = [], 0
        for m in _UTF8_CHARACTERS.finditer(word.translate(self.as_bytes)):
            out += [word[at : m.start()], m.group().encode("latin-1").decode("utf-8")]
            at = m.end()
        return "".join([*out, word[at:]]) if at else None


class _WideReader:
    """A multi-byte encoding that UTF-8 bytes may have been read in; it may have swallowed an ASCII letter."""

    def __init__(self, name: str):
        self.name = name

    def repair(self, word: str) -> str | None:
        out, changed = [], False
        for piece in re.split("(�+)", word):
            try:
                raw = piece.encode(self.name)
            except UnicodeEncodeError:
                raw = None
            if raw is None or not _UTF8.search(raw):
                out.append(piece)
                continue
            at = 0
            for m in _UTF8.finditer(raw):
                out.append(raw[at : m.start()].decode(self.name, "replace"))
                out.append(m.group().decode("utf-8"))
                at, changed = m.end(), True
            out.append(raw[at:].decode(self.name, "replace"))
        return "".join(out) if changed else None


def _readers() -> list:
    plain = [_Reader(n, _byte_table(n)) for n in READ_AS]
    small = [_Reader(n + " in small letters", _small_letters(_byte_table(n))) for n in ("cp1252", "cp1251", "cp1250", "mac_roman")]
    return [*plain, *(_WideReader(n) for n in READ_AS_WIDE), *small]


def _exchanges() -> list[tuple[str, dict[int, str]]]:
    """Character maps that undo reading text of one single-byte encoding in another."""
    out = []
    for read in READ_AS:
        table = _byte_table(read)
        for written in WRITTEN:
            if read == written:
                continue
            change = {}
            for c, b in table.items():
                try:
                    change[ord(c)] = bytes([b]).decode(written)
                except UnicodeDecodeError:
                    change[ord(c)] = "�"
            out.append((f"{read}<{written}", {k: v for k, v in change.items() if chr(k) != v}))
    return out


def code_points(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """The texts end to end with a blank on either side of each, as code points, and where each begins."""
    points = np.frombuffer((" " + "  ".join(texts) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    return points, 1 + np.r_[0, np.cumsum(lengths + 2)[:-1]].astype(np.int64)


def _slices(texts: Iterable[str]) -> Iterator[list[int]]:
    """Positions of neighbouring texts, about _SLICE characters at a time."""
    held, size = [], 0
    for k, t in enumerate(texts):
        if held and size + len(t) > _SLICE:
            yield held
            held, size = [], 0
        held.append(k)
        size += len(t)
    if held:
        yield held


def _code(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A pair of characters as one number below 2 ** 42."""
    return (left.astype(np.int64) << 21) | right.astype(np.int64)


def _mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit numbers (the finaliser of a public generator, splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SEPARATES = np.zeros(_POINTS, bool)
_SEPARATES[[*_BLANKS, *map(ord, _EDGES)]] = True


def words_beyond(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where they begin, negative hashes) of the words with a character beyond ASCII and WORD_LEAST characters."""
    inside = np.r_[False, ~_SEPARATES[points], False]
    starts, ends = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])
    beyond = np.r_[0, np.cumsum(points > 0x7F)]
    take = (beyond[ends] > beyond[starts]) & (ends - starts >= WORD_LEAST)
    starts, lengths = starts[take], (ends - starts)[take]
    if not len(starts):
        return starts, np.zeros(0, np.int64)
    first = np.r_[0, np.cumsum(lengths)[:-1]]
    place = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    letters = _mix((points[np.repeat(starts, lengths) + place].astype(np.uint64) << np.uint64(40)) + place.astype(np.uint64) + np.uint64(1))
    return starts, -1 - (np.add.reduceat(letters, first) >> np.uint64(1)).astype(np.int64)


class _Costs:
    """Costs of known pairs for whole arrays: an open hash table, looked up by array operations."""

    def __init__(self, costs: dict[str, float]):
        codes = np.fromiter(((ord(p[0]) << 21) | ord(p[1]) for p in costs), np.int64, len(costs))
        values = np.fromiter(costs.values(), np.float32, len(costs))
        self.bits = max(4, int(4 * len(costs)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, _UNKNOWN_COST, np.float32)
        slot = self._slot(codes)
        while len(codes):
            free = self.keys[slot] == -1
            _, chosen = np.unique(slot[free], return_index=True)
            placed = np.flatnonzero(free)[chosen]
            self.keys[slot[placed]], self.values[slot[placed]] = codes[placed], values[placed]
            rest = np.ones(len(codes), bool)
            rest[placed] = False
            codes, values, slot = codes[rest], values[rest], (slot[rest] + 1) & (len(self.keys) - 1)

    def _slot(self, codes: np.ndarray) -> np.ndarray:
        return (_mix(codes.view(np.uint64)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def of(self, codes: np.ndarray) -> np.ndarray:
        slot = self._slot(codes)
        out = np.full(len(codes), _UNKNOWN_COST, np.float32)
        open_ = np.arange(len(codes))
        while len(open_):
            key = self.keys[slot]
            hit = key == codes[open_]
            out[open_[hit]] = self.values[slot[hit]]
            on = ~hit & (key != -1)
            open_, slot = open_[on], (slot[on] + 1) & (len(self.keys) - 1)
        return out


def _class_masks(pairs: Sequence[tuple[str, str]]) -> tuple[np.ndarray, np.ndarray]:
    """Bits of the classes that a code point is in, as the left and as the right one of a pair."""
    left, right = np.zeros(_POINTS, np.uint16), np.zeros(_POINTS, np.uint16)
    for k, sides in enumerate(pairs):
        for mask, spans in zip((left, right), sides):
            for m in re.finditer("(.)-(.)|(.)", spans):
                low, high = (m[1], m[2]) if m[1] else (m[3], m[3])
                mask[ord(low) : ord(high) + 1] |= np.uint16(1 << k)
    return left, right


_MARK_LEFT, _MARK_RIGHT = _class_masks(_MARK_PAIRS)


class _Bytes:
    """Where bytes of a UTF-8 character may stand, by encoding: bits of lead bytes (of 2, 3 and 4) and of continuing ones."""

    def __init__(self, tables: Sequence[dict[str, int]]):
        self.lead = [np.zeros(_POINTS, np.uint32) for _ in range(3)]
        self.tail = np.zeros(_POINTS, np.uint32)
        for k, table in enumerate(tables):
            for c, b in table.items():
                kind = self.tail if b <= 0xBF else self.lead[0] if 0xC2 <= b <= 0xDF else self.lead[1] if 0xE0 <= b <= 0xEF else self.lead[2] if 0xF0 <= b <= 0xF4 else None
                if kind is not None:
                    kind[ord(c)] |= np.uint32(1 << k)

    def begin(self, points: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Bits of the encodings in which the character at each place begins a UTF-8 character.  ``at`` + 1 must exist."""
        out = self.lead[0][points[at]] & self.tail[points[at + 1]]
        for more in (1, 2):
            some = np.flatnonzero(self.lead[more][points[at]] & self.tail[points[at + 1]])
            some = some[at[some] + more + 1 < len(points)]
            bits = self.lead[more][points[at[some]]]
            for k in range(1, more + 2):
                bits = bits & self.tail[points[at[some] + k]]
            out[some] |= bits
        return out

    def by_character(self) -> dict[str, tuple[int, int, int, int]]:
        """The same for single words: lead bits of 2, 3 and 4, and tail bits, of every character that has any."""
        some = np.flatnonzero(self.tail | self.lead[0] | self.lead[1] | self.lead[2])
        return {chr(p): (*(int(lead[p]) for lead in self.lead), int(self.tail[p])) for p in some}


_STRICT_BYTES = _Bytes([_byte_table(n) for n in READ_AS])


class _PairCosts(dict):
    """Cost of any pair, its mark included; pairs met are kept up to a number."""

    def __init__(self, costs: dict[str, float]):
        super().__init__()
        self.known = costs

    def __missing__(self, pair: str) -> float:
        if len(self) >= _REMEMBERED:
            self.clear()
        self[pair] = value = self.known.get(pair, _UNKNOWN_COST) + _MARK_COST * is_mark(pair)
        return value


def is_mark(pair: str) -> bool:
    a, b = ord(pair[0]), ord(pair[1])
    return 0x80 <= a <= 0x9F or bool(_MARK_LEFT[a] & _MARK_RIGHT[b])


class _PairCosts(dict):
    """Cost of any pair, its mark included; pairs met are kept up to a number."""

    def __init__(self, costs: dict[str, float]):
        super().__init__()
        self.known = costs

    def __missing__(self, pair: str) -> float:
        if len(self) >= _REMEMBERED:
            self.clear()
        self[pair] = value = self.known.get(pair, _UNKNOWN_COST) + _MARK_COST * is_mark(pair)
        return value


def is_mark(pair: str) -> bool:
    a, b = ord(pair[0]), ord(pair[1])
    return 0x80 <= a <= 0x9F or bool(_MARK_LEFT[a] & _MARK_RIGHT[b])


class _Bytewise(dict):
    """For str.translate: characters of an encoding to the code points of their bytes; visible ASCII stays, anything else is no byte."""

    def __missing__(self, point: int) -> int:
        self[point] = value = point if 0x20 <= point < 0x7F else 0x100
        return value


class Repairer:
    """Round-trip repair of texts, given the costs of known character pairs and the hashes of known words."""

    def __init__(self, costs: dict[str, float], words: frozenset[int] = frozenset()):
        self.costs, self.words = costs, words
        self.pair = _PairCosts(costs)
        self.table = _Costs(costs)
        self.readers = _readers()
        plain = [r for r in self.readers if isinstance(r, _Reader)]
        self.wide_readers = [k for k, r in enumerate(self.readers) if isinstance(r, _WideReader)]
        self.reader_of_bit = [self.readers.index(r) for r in plain]
        self.bytes = _Bytes([r.table for r in plain])
        self.roles = self.bytes.by_character()
        self.exchanges = _exchanges()
        self.wide = [_Bytewise((ord(c), b) for c, b in _byte_table(read).items()) for read in ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1251", "cp1250")]
        self.known = known = {c for pair in costs for c in pair if ord(c) > 0x9F}
        # by character: what each exchange makes of it; bits of the exchanges that change it, and of those that may
        self.becomes: dict[str, list[str]] = {chr(p): [change.get(p, chr(p)) for _, change in self.exchanges] for p in {p for _, change in self.exchanges for p in change}}
        self.changing = {c: sum(1 << k for k, y in enumerate(ys) if y != c) for c, ys in self.becomes.items()}
        self.makes: dict[str, dict[str, int]] = {}  # what may come of a character, with the bits of the exchanges that make it
        for c, ys in self.becomes.items():
            made = self.makes[c] = {}
            for k, y in enumerate(ys):
                if y == c or ord(y) < 0x80 or y in known:
                    made[y] = made.get(y, 0) | 1 << k
        self.allowed = {c: sum(made.values()) for c, made in self.makes.items()}
        self.lost: dict[str, list[str]] = {}  # what is left of a known character's UTF-8 bytes once control codes are dropped
        for c in sorted(known):
            raw = c.encode("utf-8", "surrogatepass")
            for read in ("latin-1", "cp1252"):
                back = {b: k for k, b in _byte_table(read).items()}
                left = "".join(back[b] for b in raw if not (0x80 <= ord(back[b]) <= 0xA0 or back[b] == "\xad"))
                if left and len(left) < len(raw):
                    options = self.lost.setdefault(left, [])
                    if c not in options:
                        options.append(c)
        longest_first = sorted(self.lost, key=len, reverse=True)
        self.lost_hint = re.compile("|".join(map(re.escape, longest_first))) if longest_first else None
        self.lost_first = np.zeros(_POINTS, np.uint8)  # the longest remains that begin with a character
        for left in self.lost:
            self.lost_first[ord(left[0])] = max(self.lost_first[ord(left[0])], len(left))
        self.least_two = 2 * min(costs.values(), default=0.0)  # what a character put back costs at least
        self.seen: dict[str, tuple[str, str] | None] = {}
        self.judged: dict[str, tuple[float, int, int, int]] = {}
        self.refilled: dict[str, str | None] = {}

    def _remember(self, memory: dict, word: str, value):
        if len(memory) >= _REMEMBERED:
            memory.clear()
        if len(word) <= 64:
            memory[word] = value
        return value

    def cost(self, passage: str) -> float:
        return sum(map(self.pair.__getitem__, _SPLIT_PAIRS.findall(passage)))

    def marks(self, passage: str) -> int:
        return sum(map(is_mark, _SPLIT_PAIRS.findall(passage)))

    def _new_are_known(self, before: str, after: str) -> bool:
        """Whether every character that a repair brings in is one the corpus is known to use."""
        return all(c in self.known or ord(c) < 0x80 for c in set(after) - set(before))

    def lost_word(self, word: str) -> str | None:
        """The word (between blanks) with characters put back of which only the visible bytes are left, or None."""
        if word in self.refilled:
            return self.refilled[word]
        if self.lost_hint is None or not self.lost_hint.search(word):
            return None
        padded = f" {word} "
        get, out, at = self.costs.get, [], 0
        for m in self.lost_hint.finditer(padded):
            before, after = padded[m.start() - 1], padded[m.end() : m.end() + 1]
            options = [(get(before + c, _UNKNOWN_COST) + (get(c + after, _UNKNOWN_COST) if after else 0), c) for c in self.lost[m.group()]]
            now = self.cost(before + m.group() + after)
            best = min(options)
            out.append(padded[at : m.start()])
            out.append(best[1] if best[0] < now - _LOST_DROP else m.group())
            at = m.end()
        out.append(padded[at:])
        restored = "".join(out)
        return self._remember(self.refilled, word, None if restored == padded else restored[1:-1])

    def _is_known(self, passage: str) -> bool:
        """Whether all words beyond ASCII of a passage, one at least, are known to the corpus."""
        hashes = words_beyond(np.array([ord(c) for c in passage], np.uint32))[1].tolist()
        return bool(hashes) and all(h in self.words for h in hashes)

    def _readers_of(self, word: str) -> list[int]:
        """The encodings in which some characters of the word are the bytes of a UTF-8 character."""
        roles, none = [self.roles.get(c) for c in word], (0, 0, 0, 0)
        bits = 0
        for k, role in enumerate(roles):
            if role is not None:
                two, three, four = ((roles[j] if j < len(roles) else None) or none for j in (k + 1, k + 2, k + 3))
                bits |= two[3] & (role[0] | three[3] & (role[1] | four[3] & role[2]))
        found = [self.reader_of_bit[k] for k in range(bits.bit_length()) if bits >> k & 1]
        return [*found, *self.wide_readers] if any(ord(c) >= _WIDE_FROM and c != "\ufffd" for c in word) else found

    def word(self, word: str) -> tuple[str, str] | None:
        """The word (between blanks) restored through all layers with its route, or None if it isn't garbled UTF-8."""
        if word in self.seen:
            return self.seen[word]
        first = now = f" {word} "
        cost = start = self.cost(now) if self._readers_of(word) else 0.0
        while cost >= _LAYER_DROP:  # every layer drops the cost, so there is a last one
            options = [(self.cost(y), k, y) for k in self._readers_of(now) if (y := self.readers[k].repair(now)) is not None and y != now]
            options = [o for o in options if o[0] <= cost - _LAYER_DROP and (self._new_are_known(first, o[2]) or any(self.readers[k].repair(o[2]) for k in self._readers_of(o[2])))]
            if not options:
                break
            cost, _, now = min(options)
        sure = now != first and cost <= start - _WORD_DROP and self._new_are_known(first, now) and (cost <= start - _SURE_WORD_DROP or self.marks(now) <= self.marks(first))
        return self._remember(self.seen, word, (now[1:-1], "in part" if now.count("\ufffd") > first.count("\ufffd") else "utf-8") if sure else None)

    def _moved(self, pairs: Iterable[str], changed: set[int]) -> tuple[float, list[tuple[int, int]]]:
        """The cost of the pairs without any of the characters, and the other pairs as code points."""
        fixed, moved = 0.0, []
        for p in pairs:
            a, b = ord(p[0]), ord(p[1])
            if a in changed or b in changed:
                moved.append((a, b))
            else:
                fixed += self.pair[p]
        return fixed, moved

    def _cost_of(self, moved: list[tuple[int, int]], made: dict[int, str]) -> float:
        """The cost of pairs once characters are exchanged."""
        cost, get = 0.0, made.get
        for a, b in moved:
            p = (get(a) or chr(a)) + (get(b) or chr(b))
            if not p.isascii():
                cost += self.pair[p]
        return cost

    def _judge(self, word: str) -> tuple[float, int, int, int]:
        """Of a word between blanks: cost, doubtful pairs, marks, and bits of the exchanges that make it cheaper by characters
        that are known."""
        found = self.judged.get(word)
        if found is not None:
            return found
        padded = f" {word} "
        pairs = _SPLIT_PAIRS.findall(padded)
        cost = sum(map(self.pair.__getitem__, pairs))
        rare, marks = sum([self.costs.get(p, _UNKNOWN_COST) >= _RARE_COST for p in pairs]), sum(map(is_mark, pairs))
        helpful = 0
        if rare or marks:
            changed = [c for c in set(word) if c in self.becomes]
            bits = 0
            for c in changed:
                bits |= self.changing[c]
            classes = [(bits, {})]  # exchanges that do the same to the word are tried once
            for c in changed:
                classes = [(both, {**made, ord(c): y}) for bits, made in classes for y, mask in self.makes[c].items() if (both := bits & mask)]
            fixed, moved = self._moved(pairs, {ord(c) for c in changed})
            for bits, made in classes:
                if fixed + self._cost_of(moved, made) < cost - _WORD_DROP:
                    helpful |= bits
        return self._remember(self.judged, word, (cost, rare, marks, helpful))

    def _wide_exchanges(self, sentence: str) -> Iterator[str]:
        """The sentence with each run of bytes, as read in one encoding, strictly decoded in a multi-byte one."""
        for table in self.wide:
            as_bytes = sentence.translate(table)
            runs = [(m.start(), m.end()) for m in _RUNS.finditer(as_bytes) if not m.group().isascii()]
            for written in WRITTEN_WIDE:
                out, at = [], 0
                for low, high in runs:
                    try:
                        y = as_bytes[low:high].encode("latin-1").decode(written)
                    except UnicodeDecodeError:
                        continue
                    if len(_IDEOGRAPHS.findall(y)) >= 2:
                        out += [sentence[at:low], y]
                        at = high
                if at:
                    yield "".join([*out, sentence[at:]])

    def sentence(self, sentence: str) -> tuple[str, str] | None:
        """The sentence restored from one legacy encoding read in another with its route, or None."""
        words = [w for w in sentence.split(" ") if not w.isascii()]
        judged = [self._judge(w) for w in words]
        start = sum([j[0] for j in judged])
        rare, marks = sum([j[1] for j in judged]), sum([j[2] for j in judged])
        if not (marks or rare) or start < _SENTENCE_DROP:
            return None
        bits = 0
        for j in judged:
            bits |= j[3]
        best: tuple[float, str, str] | None = None
        if bits:
            inner = set().union(*words)
            for c in inner:
                bits &= self.allowed.get(c, -1)
            classes = [(bits, {})] if bits else []
            for c in inner & self.makes.keys():
                classes = [(both, {**made, ord(c): y}) for bits, made in classes for y, mask in self.makes[c].items() if (both := bits & mask)]
            fixed, moved = self._moved([p for w in words for p in _SPLIT_PAIRS.findall(f" {w} ")], set(map(ord, inner & self.makes.keys())))
            for _, made in classes:
                c = fixed + self._cost_of(moved, made)
                if best is None or c < best[0]:
                    best, exchange = (c, "", "single-byte"), made
            if best is not None:
                best = (best[0], sentence.translate(exchange), best[2])
        if (marks or rare >= _MANY_RARE) and _TWO_BYTES.search(sentence):
            tried = set()
            for y in self._wide_exchanges(sentence):
                if y not in tried and self._new_are_known(sentence, y):
                    tried.add(y)
                    c = self.cost(f" {y} ")
                    if best is None or c < best[0]:
                        best = (c, y, "wide")
        if best is None:
            return None
        drop, share = start - best[0], best[0] / start
        plainly, shortly, where_marks_go = _SENTENCE_SHARES
        sure = (drop >= _SENTENCE_DROP and (share <= plainly or (share <= where_marks_go and self.marks(f" {best[1]} ") < marks))) or (drop >= _SHORT_SENTENCE_DROP and rare >= 2 and share <= shortly)
        return best[1:] if sure else None

    def _passage(self, passage: str, bytes_: bool, doubt: bool, routes: set[str]) -> str:
        """One sentence through all round trips."""
        if bytes_:
            while options := strict_round_trips(passage, _LONG):  # every one is shorter, so there is a last one
                routes.add("utf-8")
                passage = min(options, key=self.cost)

            words = passage.split(" ")
            for k, word in enumerate(words):
                if not word.isascii() and (found := self.word(word)) is not None:
                    routes.add(found[1])
                    words[k] = found[0]
            passage = " ".join(words)
        if doubt and (found := self.sentence(passage)) is not None:
            routes.add(found[1])
            passage = found[0]
        return passage

    def texts(self, texts: Sequence[str]) -> list[tuple[frozenset[str], str]]:
        """(routes, restored as far as possible) of each text; no routes: it isn't garbled."""
        plain = [_ENTITY.sub(_from_entity, t) if "&#" in t else t for t in texts]
        out: list[tuple[frozenset[str], str]] = [(frozenset(("replacement",)) if "\ufffd" in t else _NO_ROUTES, t) for t in texts]
        beyond = [k for k, t in enumerate(plain) if not t.isascii() and t.strip()]
        for part in _slices([plain[k] for k in beyond]):
            self._slice([beyond[j] for j in part], texts, plain, out)
        return out

    def text(self, text: str) -> tuple[bool, str]:
        """(garbled, restored as far as possible)."""
        routes, restored = self.texts([text])[0]
        return bool(routes), restored

    def _slice(self, which: list[int], texts: Sequence[str], plain: list[str], out: list) -> None:
        points, begins = code_points([plain[k] for k in which])
        beyond = points > 0x7F
        at = np.flatnonzero(beyond[:-1] | beyond[1:])
        left, right = points[at], points[at + 1]
        cost = self.table.of(_code(left, right))
        mark = ((_MARK_LEFT[left] & _MARK_RIGHT[right]) != 0) | ((left >= 0x80) & (left <= 0x9F))
        doubt = mark | (cost >= _RARE_COST)
        encoded = (self.bytes.begin(points, at) != 0) | (left >= _WIDE_FROM)
        # a place belongs to the sentence of its character beyond ASCII
        place = np.where(left > 0x7F, at, at + 1)
        ends = np.flatnonzero((points == 0x2E) | (points == 0x21) | (points == 0x3F) | (points == 0x0A))  # . ! ? and the line's end
        lows = np.r_[begins, ends + 1]
        lows.sort()
        sentence = np.searchsorted(lows, place, "right") - 1
        kinds = np.zeros(len(lows), np.uint8)
        np.bitwise_or.at(kinds, sentence[doubt], np.uint8(1))
        np.bitwise_or.at(kinds, sentence[encoded], np.uint8(2))
        # what a lost character may have left: dear enough together with the pairs about it
        dear = np.r_[0.0, np.cumsum(cost + _MARK_COST * mark)]
        remains = self.lost_first[left]
        some = np.flatnonzero(remains)
        about = dear[np.minimum(some + remains[some], len(cost))] - dear[np.maximum(some - 1, 0)]
        kinds[sentence[some[about > _LOST_DROP + self.least_two]]] |= np.uint8(4)

        flagged = np.flatnonzero(kinds)
        owner = np.searchsorted(begins, lows[flagged], "right") - 1
        # pieces of a text: from a flagged sentence's begin to the next sentence's, or the text's end
        ends_at = np.r_[lows[1:], len(points)][flagged]
        spans: dict[int, list[tuple[int, int, int]]] = {}
        for o, low, high, kind in zip(owner.tolist(), lows[flagged].tolist(), ends_at.tolist(), kinds[flagged].tolist()):
            spans.setdefault(o, []).append((low, high, kind))
        for o, pieces in spans.items():
            k = which[o]
            text, begin, routes = plain[k], int(begins[o]), set()
            made, done = [], 0
            for low, high, kind in pieces:
                low, high = low - begin, min(high - begin, len(text))
                piece = text[low:high]
                if kind & 3:
                    piece = self._passage(piece, bool(kind & 2), bool(kind & 1), routes)
                if kind & 4 and not routes:
                    piece = self._refill(piece, routes)
                made += [text[done:low], piece]
                done = high
            if routes:
                if plain[k] != texts[k]:
                    routes.add("entities")
                restored = self._refill("".join([*made, text[done:]]), routes)
                out[k] = (out[k][0] | routes, restored)

    def _refill(self, text: str, routes: set[str]) -> str:
        """Lost characters put back: in texts that are garbled anyway, or where only known words come of it."""
        words = text.split(" ")
        for k, word in enumerate(words):
            if not word.isascii() and (y := self.lost_word(word)) is not None and (routes or self._is_known(y)):
                routes.add("lost bytes")
                words[k] = y
        return " ".join(words)


_NO_ROUTES: frozenset[str] = frozenset()
_IDEOGRAPHS = re.compile("[\u3040-\u30ff\u4e00-\u9fff]")


def _from_entity(m: re.Match) -> str:
    point = int(m.group(1))
    return chr(point) if 0x22 <= point <= 0xFFFF and not 0xD800 <= point <= 0xDFFF else m.group()


def _sound_part(text: str) -> str:
    """The text without the sentences that turn back as a whole."""
    return _SENTENCE.sub(lambda m: " " if strict_round_trips(m.group(), _STRICT) else m.group(), text)


def _held(texts: list[str], copies: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(items, copies of the texts that hold them) of some texts: codes of pairs, and negative hashes of words."""
    points, begins = code_points(texts)
    at = np.flatnonzero((points[:-1] > 0x7F) | (points[1:] > 0x7F))
    bytes_ = at[_STRICT_BYTES.begin(points, at) != 0]
    if len(bytes_):
        for o in np.unique(np.searchsorted(begins, bytes_, "right") - 1).tolist():
            texts[o] = _sound_part(texts[o])
        points, begins = code_points(texts)
        at = np.flatnonzero((points[:-1] > 0x7F) | (points[1:] > 0x7F))
    word_at, words = words_beyond(points)
    items = np.r_[_code(points[at], points[at + 1]), words]
    owner = np.searchsorted(begins, np.r_[at + 1, word_at], "right") - 1
    order = np.lexsort((owner, items))
    items, owner = items[order], owner[order]
    fresh = np.r_[True, (items[1:] != items[:-1]) | (owner[1:] != owner[:-1])] if len(items) else np.zeros(0, bool)
    items, weight = items[fresh], copies[owner[fresh]]
    heads = np.flatnonzero(np.r_[True, items[1:] != items[:-1]]) if len(items) else np.zeros(0, np.int64)
    return items[heads], np.add.reduceat(weight, heads) if len(heads) else weight


def corpus_costs(documents: DataFrame, text: str) -> tuple[dict[str, float], frozenset[int]]:
    """The pairs known to the corpus with their costs (-log of the share of all documents that hold the pair),
    and hashes of the known words beyond ASCII.  Copies of one text are one document (see ``FEW``)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def rows() -> pa.RecordBatch:
            items, n = (np.concatenate(x) for x in zip(*held))
            held.clear()
            items, at = np.unique(items, return_inverse=True)
            return pa.RecordBatch.from_arrays([pa.array(items), pa.array(np.bincount(at, n).astype(np.int64))], names=["item", "n"])

        for batch in batches:
            values, copies = batch.column(0).to_pylist(), np.asarray(batch.column(1)).astype(np.int64)
            for part in _slices(values):
                held.append(_held([values[k] for k in part], copies[part]))
            if sum(len(items) for items, _ in held) > 4_000_000:
                yield rows()
        if held:
            yield rows()

    texts = documents.select(F.col(text).alias("text")).where(F.col("text").isNotNull())
    held = texts.groupBy(F.xxhash64("text")).count().agg(F.count("*"), F.sum(F.least("count", F.lit(LEAST)))).first()
    few = held[0] < FEW
    total = held[1] if few else held[0]
    copies = F.least(F.count("*"), F.lit(LEAST if few else 1)).alias("copies")
    beyond = texts.where(F.octet_length("text") > F.char_length("text")).groupBy("text").agg(copies)
    counted = beyond.mapInArrow(count, "item long, n long").groupBy("item").agg(F.sum("n").alias("n"))
    known = counted.where(F.col("n") >= F.lit(max(float(LEAST), KNOWN * (total or 0)))).limit(MOST_KNOWN + 1).toArrow()
    if known.num_rows > MOST_KNOWN:
        raise ValueError(f"more than {MOST_KNOWN} known pairs and words; raise KNOWN")
    items, n = known.column("item").to_pylist(), known.column("n").to_pylist()
    costs = {chr(i >> 21) + chr(i & 0x1FFFFF): -math.log(k / total) for i, k in zip(items, n) if i >= 0}
    return costs, frozenset(i for i in items if i < 0)


def repair_documents(documents: DataFrame, text: str, garbled: str = "garbled", restored: str = "restored", routes: str = "routes") -> DataFrame:
    """``documents`` with ``garbled`` (boolean), ``restored`` (the text, restored as far as possible) and ``routes``
    (how it was found, sorted; empty where it isn't garbled).

    A null text is not garbled and stays null; an empty or blank one stays as it is.  Texts with replacement
    characters are garbled, though what these stood for is lost.  Other columns pass through; if one has the
    name of an added column, the added one gets a number.
    """
    spark = documents.sparkSession
    costs = spark.sparkContext.broadcast(corpus_costs(documents, text))  # at most MOST_KNOWN rows
    taken = list(documents.columns)
    names = []
    for wanted in (garbled, restored, routes):
        names.append(free_name(wanted, [*taken, *names]))
    schema = T.StructType([*documents.schema.fields, T.StructField(names[0], T.BooleanType()), T.StructField(names[1], T.StringType()), T.StructField(names[2], T.ArrayType(T.StringType()))])
    at = taken.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repairer = _repairer(costs)
        for batch in batches:
            values = batch.column(at).to_pylist()
            found = iter(repairer.texts([v for v in values if v is not None]))
            rows = [(_NO_ROUTES, None) if v is None else next(found) for v in values]
            added = [pa.array([bool(r) for r, _ in rows], pa.bool_()), pa.array([t for _, t in rows], pa.string()), pa.array([sorted(r) for r, _ in rows], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, *names])

    return documents.mapInArrow(run, schema)


_made: dict[int, Repairer] = {}


def _repairer(costs) -> Repairer:
    """One repairer a worker and corpus, with what it remembers."""
    key = id(costs.value)
    if key not in _made:
        _made.clear()
        _made[key] = Repairer(*costs.value)
    return _made[key]
