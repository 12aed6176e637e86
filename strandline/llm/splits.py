"""Train/validation/test splits that keep related records together.

Entities (sessions, authors, sources) that share a record are tied; Hash-to-min finds the components: each
node keeps a cluster, sends it to the cluster's minimum and the minimum to all its members, until nothing
changes.  Clusters are kept as rows (node, member), never as lists, so none is gathered in one task.  Records
are reduced to distinct entity links before the first shuffle, so an entity with a third of all records is
one node.  Components are then placed by weighted rendezvous hashing: every split scores
-weight / ln(md5 of seed, split and component as a number below 1) and the highest wins, so placement needs no shuffle, depends on
nothing but the component and the targets, and changing a target moves only the share that has to move.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.names import free_name
from strandline.scratch import Scratch


def hash_to_min(links: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """(entity, component) for every non-null entity in ``links``; ``component`` is the smallest tied entity.

    A row with one null end only makes its other end known.  Repeated and reversed rows make no difference.
    """
    scratch = Scratch(links.sparkSession, "splits")
    pair = links.select(F.col(a).cast("string").alias("x"), F.col(b).cast("string").alias("y")).distinct()
    both = pair.dropna()
    nodes = pair.select(F.explode(F.array("x", "y")).alias("node")).dropna()
    clusters = nodes.select("node", F.col("node").alias("member")).unionAll(both.select(F.col("x").alias("node"), F.col("y").alias("member"))).unionAll(both.select(F.col("y").alias("node"), F.col("x").alias("member"))).distinct()
    measures = {"n": F.count(F.lit(1)), "hash": F.sum(F.xxhash64("node", "member").cast("decimal(38,0)"))}
    clusters = scratch.table(clusters, **measures)
    for _ in range(max_rounds):
        if not clusters.measured["n"]:
            break
        least = clusters.groupBy("node").agg(F.min("member").alias("least"))
        sent = clusters.join(least, "node")
        after = sent.select(F.explode(F.array(F.struct(F.col("least").alias("node"), "member"), F.struct(F.col("member").alias("node"), F.col("least").alias("member")))).alias("row")).select("row.*").distinct()
        after = scratch.table(after, **measures)
        scratch.drop(clusters)
        settled = after.measured == clusters.measured
        clusters = after
        if settled:
            break
    else:
        raise RuntimeError(f"components still change after {max_rounds} rounds")
    return clusters.groupBy("node").agg(F.min("member").alias("component")).withColumnRenamed("node", "entity")


def rendezvous(key: Column, targets: Sequence[tuple[str, float]], seed: int = 0) -> Column:
    """The split of ``key``: the one of ``targets`` (name, weight > 0) with the highest weighted score."""
    live = [(name, float(w)) for name, w in targets if name is not None and w is not None and w > 0]
    if not live:
        raise ValueError("no split has a positive proportion")
    scores = []
    for name, weight in live:
        digits = F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(name), key.cast("string"))), 1, 13)
        unit = (F.conv(digits, 16, 10).cast("bigint").cast("double") + 0.5) / float(1 << 52)
        scores.append(F.struct((F.lit(-weight) / F.log(unit)).alias("score"), F.lit(name).alias("name")))
    return F.greatest(*scores)["name"] if len(scores) > 1 else F.lit(live[0][0])


def split_targets(table: DataFrame) -> list[tuple[str, float]]:
    """The targets as rows on the driver: one per split, a handful by nature; repeated rows count once."""
    rows = table.select("partition_name", "proportion").dropna().distinct().limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError("more than 1,000 splits")
    return sorted((r[0], r[1]) for r in rows)


def assign_splits(records: DataFrame, entity: str, alias: str | None, targets: Sequence[tuple[str, float]], own: Sequence[str], seed: int = 0) -> DataFrame:
    """``records`` with ``component`` and ``split`` added: records with tied entities share both.

    ``entity`` is a record's entity and ``alias`` another entity that ties with it (or None); both may be null.  A
    record without any entity is tied to none but its own repeats: it is placed by the values of ``own``.
    Columns of ``records`` called component or split stay, the added ones then get a number.
    """
    links = records.select(F.col(entity).alias("a__"), F.col(alias or entity).alias("b__"))
    found = hash_to_min(links, "a__", "b__")
    key, comp, part = (free_name(n, records.columns) for n in ("entity__", "component", "split"))
    keyed = records.withColumn(key, F.coalesce(F.col(entity).cast("string"), F.col(alias or entity).cast("string")))
    alone = F.concat_ws("\u0001", F.lit("\u0001alone"), *(F.coalesce(F.col(c).cast("string"), F.lit("\u0002")) for c in own))
    placed = found.select(F.col("entity").alias(key), F.col("component").alias(comp))
    out = keyed.join(placed, key, "left").withColumn(comp, F.coalesce(F.col(comp), alone)).drop(key)
    return out.withColumn(part, rendezvous(F.col(comp), targets, seed))


def consolidate(records: DataFrame, spelling: Column, name: Column, out: str) -> DataFrame:
    """``records`` with ``out``: the name that hash-to-min finds for each record's ``spelling``.

    Every spelling with a non-null ``name`` is tied to it; a component is a name with all its spellings, and its
    smallest member is the name, for spellings are told apart by a first character beyond all of a name's.  One spelling
    must not have two names: it would join them, and the smaller one would stand for both.  A record with a null
    spelling or name has null.  A column of ``records`` called ``out`` stays, the added one then gets a number.
    """
    key, out = free_name("spelling__", records.columns), free_name(out, records.columns)
    keyed = records.withColumn(key, F.when(name.isNotNull(), F.concat(F.lit(_LAST), spelling)))
    found = hash_to_min(keyed.select(F.col(key).alias("a__"), F.when(F.col(key).isNotNull(), name).alias("b__")), "a__", "b__")
    found = found.where(F.col("entity").startswith(_LAST)).select(F.col("entity").alias(key), F.col("component").alias(out))
    return keyed.join(found, key, "left").drop(key)


def _between(text: Column, pattern: str) -> Column:
    found = F.regexp_extract(text, pattern, 1)
    return F.when(found != "", found)


_LAST = "\U0010ffff"
_KEY = r"[0-9]{8}_s[0-9]+_[a-z]+_[a-z]+"


def own_key(person_session: Column) -> Column:
    """The key that a person-session reads as, in lower case, without surrounding white space and with blanks, ``-``
    and ``_`` unified; or null."""
    own = F.regexp_replace(F.regexp_replace(F.lower(person_session), r"(?U)^\s+|\s+$", ""), r"(?U)[\s_-]+", "_")
    return _between(own, rf"^({_KEY})\z")


def session_reading(person_session: Column, sequence_name: Column, video_path: Column) -> Column:
    """struct(spelling, name) of an activity segment: the text that its key ``{date}_s{n}_{first}_{last}`` is read from,
    and the key; null if there is none.

    It is read from the sequence name, else from the first directory of the video path that reads so, else from
    the person-session.
    """
    act = r"_act[0-9]+_[a-z0-9]+"
    named = _between(sequence_name, rf"^({_KEY}){act}\z")
    folder = _between(video_path, rf"(?:^|/)({_KEY}{act})/")
    own = own_key(person_session)

    def read(spelling: Column, name: Column) -> Column:
        return F.when(name.isNotNull(), F.struct(spelling.alias("spelling"), name.alias("name")))

    return F.coalesce(read(sequence_name, named), read(folder, _between(folder, rf"^({_KEY})")), read(person_session, own))
