"""Operator 1. N-gram Jaccard join by grouped prefixes.

Documents are sets of distinct n-word shingles (64-bit hashes). Shingles are
ordered rarest first: those that are not known to be frequent by hash, then the
frequent ones by count. The order only steers work; any order gives right results.
A document of s shingles can link only to one that shares one of its first
s - ceil(t s) + 1 shingles. Documents with identical prefixes and size are one
group, only groups enter the prefix index, and lists of one group drop out. What
is left is expanded to classes of equal sets. A pair of classes whose prefixes show
too few common shingles drops out (an exact bound); the others are verified on whole
sets: first each list against one leader, which joins large groups of copies in
linear work; then, among those that one leader brought together but that are not in
one component, blocks against blocks, whose pairs are counted inside a task and
never become rows; then every other pair of a list whose ends are not yet in one
component. So no component is missed.

Defined cases: null or empty text has no shingle and links with nothing; a row
with null id takes no part and gets a null component; repeated rows are one
document; rows that share an id count as linked. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from pageloom.llm import textkit as tk
from pageloom.plans.components import connected_components
from pageloom.runtime import Scratch, ship

#: Counted shingles from this count on are frequent, and of those the order knows so many at most.
FREQUENT, FREQUENT_MOST = 16, 1 << 20
#: Up to so many ids are sent to all executors; beyond, a shuffled join picks the rows.
IDS_SENT = 1 << 20
MEMBERS_A_TASK_KEY = 64
#: Classes of a block, and shingles on average; a task holds the sets of two blocks.
BLOCK, BLOCK_SHINGLES = 256, 1 << 18
#: A leader's classes are compared in blocks from this many on.
LARGE = 32


def _sets(batches, text_col: str, n: int):
    """Per slice: batch, sorted distinct shingle hashes of all rows, bounds."""
    for batch, data, offs in tk.slices(batches, text_col):
        low = tk.lower_ascii(data)
        starts, ends = tk.runs(tk.NOT_SPACE[low], offs)
        flat, bounds = tk.shingle_hashes(tk.span_hashes(low, starts, ends), tk.row_bounds(starts, offs), n)
        for i in range(len(bounds) - 1):
            flat[bounds[i] : bounds[i + 1]].sort()
        keep = np.ones(len(flat), dtype=bool)
        keep[1:] = flat[1:] != flat[:-1]
        keep[bounds[:-1][bounds[:-1] < len(flat)]] = True
        yield batch, flat[keep], np.concatenate([[0], np.cumsum(keep)])[bounds]


def _needed(size, percent: int):
    return -(-percent * size // 100)


def _frequent(docs: DataFrame, text_col: str, n: int, percent: int, scratch: Scratch) -> np.ndarray:
    """The most frequent of the shingles that can come near a prefix, by count; bounded by FREQUENT_MOST."""

    @tk.releasing
    def lowest(batches):
        for _, flat, bounds in _sets(batches, text_col, n):
            size = np.diff(bounds)
            most = np.minimum(size, (size - _needed(size, percent)) * 3 // 2 + 4)
            at = np.arange(len(flat)) - np.repeat(bounds[:-1], size)
            token, count = np.unique(flat[at < np.repeat(most, size)], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(count.astype(np.int64))], ["token", "c"])

    counts = docs.select(text_col).mapInArrow(lowest, "token long, c long").groupBy("token").agg(F.sum("c").alias("c")).where(f"c >= {FREQUENT}")
    counts = scratch.save(counts, "counts")
    # the least grade (count on a log scale) that leaves few enough, from the number of shingles by grade
    grade = F.floor(F.log2("c") * 16)
    by_grade = {r["k"]: r["n"] for r in counts.groupBy(grade.alias("k")).agg(F.count("*").alias("n")).collect()}
    least, held = 1 << 20, 0
    for k in sorted(by_grade, reverse=True):
        if held + by_grade[k] > FREQUENT_MOST:
            break
        least, held = k, held + by_grade[k]
    found = counts.where(grade >= least).toArrow()
    scratch.drop("counts")
    token, c = (found.column(k).to_numpy() for k in range(2))
    return token[np.lexsort((token, -c))].view(np.uint64)


def _prefixes(docs: DataFrame, id_col: str, text_col: str, n: int, percent: int, frequent: np.ndarray) -> DataFrame:
    """A row for each document: set size, signatures of the set and of prefix and size, the prefix, and whether a task sees its group first here.

    A prefix holds ascending 64-bit keys: half the hash of a shingle that isn't known as frequent, then 2^63 and the rarity rank of frequent ones.
    """
    order = np.argsort(frequent)
    sent = docs.sparkSession.sparkContext.broadcast((frequent[order], (np.uint64(1) << np.uint64(63)) + (len(frequent) - 1 - order).astype(np.uint64)))

    @tk.releasing
    def rows(batches):
        known, key_of = sent.value
        seen: set[bytes] = set()
        for batch, flat, bounds in _sets(batches, text_col, n):
            keys = flat >> np.uint64(1)
            hits = np.zeros(len(bounds), dtype=np.int64)
            if len(known):
                at = np.minimum(np.searchsorted(known, flat), len(known) - 1)
                hit = known[at] == flat
                keys[hit] = key_of[at[hit]]
                hits = np.concatenate([[0], np.cumsum(hit)])[bounds]
            ids = batch.column(batch.schema.get_field_index(id_col)).cast(pa.int64())
            named = ids.is_valid().to_pylist()
            sigs, groups, prefixes, first = [], [], [], []
            for i in range(batch.num_rows):
                lo, hi = bounds[i], bounds[i + 1]
                size = int(hi - lo)
                if not size:
                    sigs.append(None), groups.append(None), prefixes.append(None), first.append(False)
                    continue
                sigs.append(hashlib.blake2b(flat[lo:hi].tobytes(), digest_size=16).digest())
                if hits[i + 1] > hits[i]:
                    keys[lo:hi].sort()
                prefixes.append(keys[lo : lo + size - int(_needed(size, percent)) + 1].tobytes())
                groups.append(hashlib.blake2b(prefixes[-1] + size.to_bytes(8, "little"), digest_size=16).digest())
                # a row without id is not indexed, so it can't stand for its group
                first.append(named[i] and groups[-1] not in seen)
                if named[i] and len(seen) < 1 << 20:
                    seen.add(groups[-1])
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(np.diff(bounds)), pa.array(sigs, pa.binary()), pa.array(groups, pa.binary()), pa.array(prefixes, pa.binary()), pa.array(first)],
                ["doc_id", "n", "sig", "grp", "prefix", "first"],
            )

    return docs.select(id_col, text_col).mapInArrow(rows, "doc_id long, n long, sig binary, grp binary, prefix binary, first boolean")


def _index(rows: DataFrame) -> DataFrame:
    """(bearer, pos, token) of the prefixes of ``rows``."""

    @tk.releasing
    def spread(batches):
        for batch in batches:
            size = np.array([len(x) // 8 for x in batch.column(1).to_pylist()], dtype=np.int64)
            token = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.int64)
            pos = np.arange(len(token)) - np.repeat(np.cumsum(size) - size, size)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), size)), pa.array(pos.astype(np.int32)), pa.array(token)], ["bearer", "pos", "token"])

    return rows.where("first and doc_id is not null").select("doc_id", "prefix").mapInArrow(spread, "bearer long, pos int, token long")


def _whole_sets(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """(node, n, blob) of the rows whose id is in ``ids(node)``: sorted shingle hashes."""
    ids = F.broadcast(ids) if ids.count() <= IDS_SENT else ids
    chosen = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).alias("text")).join(ids, "node", "left_semi")

    @tk.releasing
    def rows(batches):
        for batch, flat, bounds in _sets(batches, "text", n):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(bounds)), tk.ragged_binary(flat, bounds)], ["node", "n", "blob"])

    return chosen.mapInArrow(rows, "node long, n long, blob binary")


def _kept(pairs: DataFrame, blobs: DataFrame, test) -> DataFrame:
    """Those of ``pairs(a, b)`` for which ``test(n_a, blob_a, n_b, blob_b)`` holds. A leader's blob travels once for up to 64 members or so."""
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / MEMBERS_A_TASK_KEY).alias("parts"))
    dealt = pairs.join(many, "a").select("a", "b", F.expr("pmod(xxhash64(b), parts)").alias("part"))
    members = dealt.join(blobs.select(F.col("node").alias("b"), "n", "blob"), "b").select("a", "part", "b", "n", "blob")
    leaders = dealt.select("a", "part").distinct().join(blobs.select(F.col("node").alias("a"), "n", "blob"), "a").select("a", "part", F.lit(None).cast("long").alias("b"), "n", "blob")

    @tk.releasing
    def check(batches):
        size, mine = 0, None
        for batch in batches:
            a, b, n = (batch.column(k).to_pylist() for k in (0, 2, 3))
            left, right = [], []
            for i, blob in enumerate(batch.column(4)):
                other = np.frombuffer(blob.as_buffer(), dtype=np.uint64)
                if b[i] is None:
                    size, mine = n[i], other.copy()
                elif test(size, mine, n[i], other):
                    left.append(a[i]), right.append(b[i])
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    dealt = leaders.union(members).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    return dealt.mapInArrow(check, "a long, b long").distinct()


def _common(x: np.ndarray, y: np.ndarray) -> int:
    at = np.searchsorted(x, y)
    at[at == len(x)] = 0
    return int(np.count_nonzero(x[at] == y))


def _block_links(held: DataFrame, sets: DataFrame, enough) -> DataFrame:
    """Links (a, b) between classes of one home, ``held(node, home, component, blocks)``: every two blocks of a home meet in one task, which holds both."""
    dealt = held.withColumn("block", F.expr("pmod(xxhash64(node), blocks)")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("home", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "component").join(sets, "node")

    def links(group):
        block = np.array([g[0] for g in group])
        node, component, size = (np.array([g[k] for g in group], dtype=np.int64) for k in (1, 2, 3))
        common = tk.common_counts([g[4] for g in group])
        both = size[:, None] + size[None, :]
        good = enough(common, 0, both) & (component[:, None] != component[None, :]) & (node[:, None] < node[None, :])
        if block.min() != block.max():
            good &= block[:, None] != block[None, :]
        x, y = np.nonzero(good)
        return node[x], node[y]

    @tk.releasing
    def run(batches):
        now, group = None, []
        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in range(3))))
            block, node, component, size = (batch.column(k).to_pylist() for k in (3, 4, 5, 6))
            found = []
            for i, key in enumerate(keys):
                if key != now:
                    if len(group) > 1:
                        found.append(links(group))
                    now, group = key, []
                group.append((block[i], node[i], component[i], size[i], np.frombuffer(batch.column(7)[i].as_buffer(), dtype=np.uint64).copy()))
            for a, b in found:
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
        if len(group) > 1:
            a, b = links(group)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    dealt = dealt.select("home", "i", "j", "block", "node", "component", "n", "blob").repartition("home", "i", "j").sortWithinPartitions("home", "i", "j")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def ngram_jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 4, percent: int = 85) -> DataFrame:
    """A row for each row of ``docs``: doc_id, n_shingles, component_id."""
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "ngram")
    all_rows = scratch.save(_prefixes(docs, id_col, text_col, n, percent, _frequent(docs, text_col, n, percent, scratch)), "rows")
    classes = scratch.save(all_rows.where("doc_id is not null and sig is not null").groupBy("sig").agg(F.min("doc_id").alias("node"), F.first("n").alias("n"), F.first("grp").alias("grp")), "classes")

    listed = _index(all_rows).withColumn("df", F.count("*").over(Window.partitionBy("token"))).where("df > 1").drop("df")
    listed = scratch.save(listed, "listed")
    bearers = listed.select("bearer").distinct().join(all_rows.where("first").select(F.col("doc_id").alias("bearer"), "grp"), "bearer")
    spread = listed.join(bearers, "bearer").select("token", "pos", "grp").join(classes.select("grp", "node", "n"), "grp").select("token", "pos", "node", "n")
    several = classes.withColumn("m", F.count("*").over(Window.partitionBy("grp"))).where("m > 1").select(F.xxhash64("grp", F.lit("group")).alias("token"), F.lit(0).alias("pos"), "node", "n")
    lists = scratch.save(spread.union(several).groupBy("token", "node").agg(F.min("pos").alias("pos"), F.first("n").alias("n")), "lists")
    scratch.drop("listed")
    near = f"100 * least(n, m) >= {percent} * greatest(n, m) and {100 + percent} * (least(pos, qos) + least(n - pos, m - qos)) >= {percent} * (n + m)"
    of_class = classes.join(lists.select("node").distinct(), "node", "left_semi").select("node", "sig")
    prefixes = scratch.save(all_rows.select(F.col("doc_id").alias("node"), "sig", "n", F.col("prefix").alias("blob")).join(of_class, ["node", "sig"], "left_semi").drop("sig").dropDuplicates(["node"]), "prefixes")

    def enough(common, n_a, n_b):
        return (100 + percent) * common >= percent * (n_a + n_b)

    def may_link(n_a, x, n_b, y):
        """Up to the smaller last key both prefixes show all shingles of their sets."""
        last = min(x[-1], y[-1])
        seen_x, seen_y = np.searchsorted(x, last, side="right"), np.searchsorted(y, last, side="right")
        return enough(_common(x, y) + min(n_a - int(seen_x), n_b - int(seen_y)), n_a, n_b)

    def sets_of(ids: DataFrame, name: str) -> DataFrame:
        return scratch.save(_whole_sets(docs, scratch.save(ids.distinct(), f"ids_{name}"), id_col, text_col, n), f"sets_{name}")

    def links_of(pairs: DataFrame, name: str) -> DataFrame:
        sets = sets_of(pairs.select(F.explode(F.array("a", "b")).alias("node")), name)
        return scratch.save(_kept(pairs, sets, lambda n_a, x, n_b, y: enough(_common(x, y), n_a, n_b)), f"links_{name}")

    # each list against its smallest class; before, every class is a component of its own
    lead = lists.groupBy("token").agg(F.min_by(F.struct("node", "pos", "n"), "node").alias("lead")).select("token", F.col("lead.node").alias("a"), F.col("lead.pos").alias("qos"), F.col("lead.n").alias("m"))
    pairs = lists.join(lead, "token").where("a <> node").where(near).select("a", F.col("node").alias("b")).distinct()
    star = scratch.save(pairs, "star")
    led = scratch.save(_kept(star, prefixes, may_link), "led")
    links = links_of(led, "led")
    component = scratch.save(connected_components(links), "component_led")

    def with_component(df: DataFrame) -> DataFrame:
        return df.join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))

    # blocks against blocks among the many classes that share their smallest leader
    home = star.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("home"))
    for k in range(2):  # a leader that has a leader itself hands its members on
        home = scratch.save(home, f"home{k}")
        home = home.join(home.select(F.col("node").alias("home"), F.col("home").alias("next")), "home", "left").select("node", F.coalesce("next", "home").alias("home"))
    home = scratch.save(home, "home2")
    # few members are cheaper pair by pair
    large = scratch.save(home.groupBy("home").agg(F.count("*").alias("m")).where(f"m >= {LARGE}").select("home"), "large")
    # a home is a member of its own blocks, as handed-on members have not met it; it leaves the home it may have itself
    moved = home.join(large, "home", "left_semi").select("node", "home").join(large.select(F.col("home").alias("node")), "node", "left_anti")
    home = scratch.save(moved.union(large.select(F.col("home").alias("node"), "home")), "home")
    held = with_component(home)
    apart = held.groupBy("home").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("home")
    held = scratch.save(held.join(apart, "home"), "held")
    if held.take(1):
        sets = sets_of(held.select("node"), "held")
        blocks = held.join(sets.select("node", "n"), "node").groupBy("home").agg(F.expr(f"greatest(ceil(count(*) / {BLOCK}), ceil(sum(n) / {BLOCK_SHINGLES}))").alias("blocks"))
        got = scratch.save(_block_links(held.join(blocks, "home"), sets, enough), "links_held")
        links = links.union(got)
        component = scratch.save(connected_components(links), "component_held")

    # the rest, pair by pair
    here = with_component(lists).join(home, "node", "left").withColumn("home", F.coalesce("home", "node"))
    mixed = here.groupBy("token").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.min("home").alias("v"), F.max("home").alias("w")).where("x <> y and v <> w").select("token")
    here = here.join(mixed, "token", "left_semi")
    other = here.select("token", F.col("node").alias("a"), F.col("pos").alias("qos"), F.col("n").alias("m"), F.col("component").alias("other"), F.col("home").alias("place"))
    cross = here.join(other.withColumnRenamed("token", "same"), F.expr(f"token = same and a < node and component <> other and home <> place and {near}"))
    pairs = cross.select("a", F.col("node").alias("b")).distinct().join(led, ["a", "b"], "left_anti")
    pairs = scratch.save(_kept(pairs, prefixes, may_link), "rest")
    if pairs.take(1):
        got = links_of(pairs, "rest")
        if got.take(1):
            component = scratch.save(connected_components(links.union(got)), "component")
    out = all_rows.select("doc_id", "n", "sig").join(classes.select("sig", "node"), "sig", "left").join(component, "node", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "node", "doc_id")).alias("component_id"))
