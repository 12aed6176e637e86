from __future__ import annotations

import pytest

from strandline.llm.mojibake import repair_documents, strict_round_trips
from tests.llm.test_mojibake import SOUND


def _corpus(bad: str, near: bool, sound: list[str] = SOUND) -> list[tuple[int, str]]:
    """600 different sound texts, and a third of all rows copies (or near copies, with another number) of a garbled one."""
    rows = [(k, f"{sound[k % len(sound)]} No. {k}.") for k in range(600)]
    return rows + [(10_000 + k, f"{bad} No. {k}." if near else bad) for k in range(300)]


RUSSIAN = SOUND[5]
CASES = [
    (RUSSIAN, RUSSIAN.encode("utf-8").decode("cp1251", "replace"), False),
    (RUSSIAN, RUSSIAN.encode("utf-8").decode("latin-1"), False),
    (RUSSIAN, RUSSIAN.encode("utf-8").decode("latin-1"), True),
    (SOUND[0], SOUND[0].encode("utf-8").decode("latin-1"), False),
    (SOUND[4], SOUND[4].encode("utf-8").decode("cp1251", "replace"), False),
    (SOUND[4], SOUND[4].encode("utf-8").decode("latin-1"), True),
    (RUSSIAN, RUSSIAN.encode("cp1251").decode("cp1252"), False),
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_copies_of_a_garbled_text_do_not_vouch_for_it(spark, case):
    sound, bad, near = CASES[case]
    rows = {r["doc_id"]: r for r in repair_documents(spark.createDataFrame(_corpus(bad, near), "doc_id long, text string"), "text").collect()}
    assert [k for k in range(600) if rows[k]["garbled"]] == []
    assert all(rows[10_000 + k]["garbled"] for k in range(300))
    if "�" not in bad:
        assert rows[10_000]["restored"].startswith(sound)


def test_long_strict_round_trip_needs_no_known_characters(spark):
    bad = RUSSIAN.encode("utf-8").decode("latin-1")
    latin = [t for t in SOUND if not any("Ѐ" <= c <= "ӿ" for c in t)]
    rows = {r["doc_id"]: r for r in repair_documents(spark.createDataFrame(_corpus(bad, True, latin), "doc_id long, text string"), "text").collect()}
    assert all(rows[10_000 + k]["garbled"] and rows[10_000 + k]["restored"] == f"{RUSSIAN} No. {k}." for k in range(300))
    assert [k for k in range(600) if rows[k]["garbled"]] == []


def test_sound_text_is_no_strict_round_trip():
    assert [t for t in SOUND if strict_round_trips(t, 1)] == []


def test_blank_texts_stay_though_copies_no_longer_vouch_for_them(spark):
    rows = _corpus(" \xa0 ", False)
    out = repair_documents(spark.createDataFrame(rows, "doc_id long, text string"), "text")
    assert out.where("garbled").count() == 0
