"""Operator 5. Suffix-array dedup of byte strings, built block by block with a cover sample.

A byte is removed if a string of ``width`` bytes that covers it starts anywhere else
too, in its own document or another, judged on the input. Equal texts are settled
first: all their bytes go. One text of each kind stays for the others.

Only suffixes that can repeat are sorted. Every ``width``-byte string elects the place
with the least hash of ANCHOR bytes in it (winnowing), so equal strings elect equal
anchors at equal places. Anchors that occur once drop out with all their strings. The
others' surroundings are dealt by anchor: these are the suffix buckets, sorted one
block of buckets at a time. The texts of a block are laid out so that the anchors of
a bucket stand at equal residues modulo the cover's period. The cover sample, places
whose residue is in a difference cover, is ranked first, by prefix doubling to more
than ``width`` bytes. Suffixes are then sorted by bucket, residue and PERIOD bytes,
and longer ties by the rank of the next sample place, which lies at the same distance
for all suffixes of a bucket and residue. Neighbours in that order that agree in
``width`` bytes repeat. Equal surroundings send their bytes once a block. Memory is that
of a block.

An anchor with very many places (HOT) would fill a bucket: its strings are dealt one by
one by 128 bits of their bytes, after those that a task has met twice are settled there.

Defined cases: null text is empty; texts shorter than ``width`` lose nothing; repeated
rows are copies of each other, so they lose all their bytes if long enough; null ids
and rows that share an id are treated like others, as texts are told apart by their
content (two 64-bit hashes of it name a text between steps); other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pageloom.llm import textkit as tk
from pageloom.llm.bpe import ragged_index
from pageloom.runtime import Scratch, ship

ANCHOR = 32
PERIOD = 32
#: Rows of a table, and elements of their lists, that may be sent to all executors (some 30 MB); beyond, a shuffled join.
SENT = 1 << 20
#: Anchors with so many places are hot; HOT_MOST of them at most, as beyond the least number grows. Their strings are dealt one by one, by their bytes.
HOT, HOT_MOST = 20_000, 1 << 20
#: Texts of which one row of so many is a copy are hot; there are at most so many.
HOT_COPIES = 1 << 16
#: Anchors of a bucket of the index, and bytes of a bucket of surroundings, on average; bytes sorted at once.
BUCKET_ANCHORS, BUCKET_BYTES, BLOCK = 250_000, 3 << 20, 1 << 20


def difference_cover(period: int) -> list[int]:
    """Residues such that every distance modulo the period lies between two of them; greedy."""
    cover, missing = [0], set(range(1, period))
    while missing:
        gain = lambda r: len({(r - c) % period for c in cover} & missing) + len({(c - r) % period for c in cover} & missing)
        best = max(range(period), key=lambda r: (gain(r), -r))
        cover.append(best)
        missing -= {(a - b) % period for a in cover for b in cover}
    return sorted(cover)


def anchors(data: np.ndarray, offs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Elected places: place in the block, its hash, and the first and last string start that elect it."""
    n, span = len(data), width - ANCHOR + 1
    starts = n - width + 1
    none = np.empty(0, np.int64)
    if starts <= 0:
        return none, none.astype(np.uint64), none, none
    value = tk._BYTE_VALUE[data]
    power, size = 0x9E3779B97F4A7C15, 1
    while size < ANCHOR:
        value = value[:-size] + np.uint64(power) * value[size:]
        power, size = power * power % (1 << 64), 2 * size
    hashes = tk.mix(value)
    # half of the hash and the place: the least one is the leftmost least hash
    least = (hashes >> np.uint64(32) << np.uint64(32)) | np.arange(len(hashes), dtype=np.uint64)
    reach = 1
    while 2 * reach <= span:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < span:
        least = np.minimum(least[: len(least) - (span - reach)], least[span - reach :])
    place = (least[:starts] & np.uint64((1 << 32) - 1)).astype(np.int64)
    # strings that cross into the next row don't count
    row_end = np.repeat(offs[1:], np.diff(offs))[:starts]
    inside = np.arange(starts) + width <= row_end
    at = np.flatnonzero(inside)
    if not len(at):
        return none, none.astype(np.uint64), none, none
    place = place[at]
    head = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (np.diff(at) != 1)]))
    stop = np.append(head[1:], len(at)) - 1
    return place[head], hashes[place[head]], at[head], at[stop]


def repeated_starts(text: np.ndarray, begin: np.ndarray, size: np.ndarray, anchor_at: np.ndarray, bucket: np.ndarray, count: np.ndarray, width: int) -> np.ndarray:
    """For pieces text[begin:begin + size] with an anchor (offset in the piece) and a bucket: flags of the strings at
    their first ``count`` places, one after another, that another piece of the bucket has at the same distance from its anchor."""
    cover = np.array(difference_cover(PERIOD))
    # lay the pieces out anew, anchors at residue 0, zeros between
    room = -(-(size + PERIOD) // PERIOD) * PERIOD
    shift = -anchor_at % PERIOD
    new = np.concatenate([[0], np.cumsum(room + PERIOD)])
    laid = np.zeros(new[-1] + 2 * width + 8 * PERIOD, dtype=np.uint8)
    new = new[:-1] + shift
    laid[ragged_index(new, size)] = text[ragged_index(begin, size)]
    word = np.zeros(len(laid) - 8, dtype=np.uint64)
    for k in range(8):
        word = word << np.uint64(8) | laid[k : len(laid) - 8 + k]

    def ranked(*keys: np.ndarray) -> np.ndarray:
        """Dense ranks of rows, the first key foremost."""
        order = np.lexsort(keys[::-1])
        step = np.zeros(len(order), dtype=bool)
        for k in keys:
            step[1:] |= k[order][1:] != k[order][:-1]
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.cumsum(step)
        return rank

    # the sample: ranked by PERIOD bytes, then by twice as many until width is passed
    blocks = (len(word) - PERIOD) // PERIOD
    sample = (np.arange(blocks)[:, None] * PERIOD + cover[None, :]).ravel()
    rank = ranked(*(word[sample + 8 * k] for k in range(PERIOD // 8)))
    depth, m = PERIOD, len(cover)
    while depth < width:
        hop = depth // PERIOD * m
        ahead = np.zeros_like(rank)
        ahead[:-hop] = rank[hop:] + 1
        rank = ranked(rank, ahead)
        depth *= 2
    start = ragged_index(new, count)
    owner = np.repeat(np.arange(len(begin)), count)
    residue = start % PERIOD
    # distance to the next sample place, by residue, and that place's index in the sample
    ahead = np.array([min((c - r) % PERIOD for c in cover.tolist()) for r in range(PERIOD)])
    at = start + ahead[residue]
    in_sample = at // PERIOD * m + np.searchsorted(cover, at % PERIOD)
    distance = start - new[owner] - anchor_at[owner]
    # the PERIOD bytes at a place: the ahead bytes before the sample place, then what the sample's rank says
    keys = [bucket[owner], distance, *(word[start + 8 * k] for k in range(PERIOD // 8)), rank[in_sample]]
    order = np.lexsort(keys[::-1])
    same = np.ones(max(len(order) - 1, 0), dtype=bool)
    for k in keys[:-1]:
        same &= k[order][1:] == k[order][:-1]
    # neighbours: compared to the full width, eight bytes at a time
    left, right = np.flatnonzero(same), None
    right = left + 1
    for k in [*range(PERIOD, width - 8, 8), width - 8]:
        equal = word[start[order[left]] + k] == word[start[order[right]] + k]
        left, right = left[equal], right[equal]
    flags = np.zeros(len(start), dtype=bool)
    flags[order[left]] = True
    flags[order[right]] = True
    return flags


HEAD = np.dtype([("hash", "<u8"), ("w1", "<u8"), ("w2", "<u8"), ("k1", "<i8"), ("k2", "<i8"), ("first", "<i4"), ("count", "<i4"), ("anchor", "<i4"), ("size", "<i4"), ("held", "<i4")])
PLACE = np.dtype([("hash", "<u8"), ("k1", "<i8"), ("k2", "<i8"), ("at", "<i4"), ("n", "<i4")])
STRING = np.dtype([("w1", "<u8"), ("w2", "<u8"), ("k1", "<i8"), ("k2", "<i8"), ("first", "<i4"), ("n", "<i4")])


def _dealt(bucket: np.ndarray):
    """Order by bucket, and (bucket, from, to) runs."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    head = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.empty(0, np.int64)
    return order, bucket[head], head, np.append(head[1:], len(bucket))


def _by_bucket(batches):
    """Lists of rows of equal first column; the partition is sorted by it."""
    now, held = None, []
    for batch in batches:
        for k in range(batch.num_rows):
            bucket = batch.column(0)[k].as_py()
            if bucket != now and held:
                yield held
                held = []
            now = bucket
            held.append([c[k].as_py() for c in batch.columns])
    if held:
        yield held


class Often:
    """Values that a task has met twice in one block, up to ``most``: what it meets of them later repeats for sure, and only their number is sent on."""

    def __init__(self, most: int = 1 << 16):
        self.values, self.counts, self.most = np.empty(0, np.uint64), np.empty(0, np.int64), most

    def meet(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flags of the values that repeat for sure, and of those to send on as the first of a value."""
        some, first, inverse, count = np.unique(values, return_index=True, return_inverse=True, return_counts=True)
        if len(self.values):
            at = np.minimum(np.searchsorted(self.values, some), len(self.values) - 1)
            known = self.values[at] == some
            np.add.at(self.counts, at[known], count[known])
        else:
            known = np.zeros(len(some), dtype=bool)
        send = np.zeros(len(values), dtype=bool)
        send[first[~known]] = True
        sure = (known | (count > 1))[inverse]
        new = np.flatnonzero(~known & (count > 1))[: self.most - len(self.values)]
        values, counts = np.concatenate([self.values, some[new]]), np.concatenate([self.counts, np.zeros(len(new), np.int64)])
        order = np.argsort(values)
        self.values, self.counts = values[order], counts[order]
        return sure, send


def _small(df: DataFrame, lists: str | None = None) -> DataFrame:
    """``df`` marked for a broadcast if its rows, and what they list, are few."""
    n, listed = df.agg(F.count("*"), F.sum(F.size(lists).cast("long")) if lists else F.lit(0)).first()
    return F.broadcast(df) if n + max(listed or 0, 0) <= SENT else df


def _packed(name: str, bucket: np.ndarray, records: np.ndarray) -> pa.RecordBatch:
    order, bucket, head, stop = _dealt(bucket)
    records = records[order]
    return pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int64)), pa.array([records[a:b].tobytes() for a, b in zip(head, stop)], pa.binary()), pa.array([b""] * len(head), pa.binary())], [name, "heads", "bytes"])


def _repeats(docs: DataFrame, width: int, scratch: Scratch) -> DataFrame:
    """``docs(k1, k2, text)`` of different texts to (k1, k2, first, last): runs of string starts that repeat."""
    sc, block = docs.sparkSession.sparkContext, BLOCK

    @tk.releasing
    def elected(batches):
        often = Often()
        for batch, data, offs in tk.slices(batches, "text", tk.BLOCK_BYTES):
            place, hashes, first, last = anchors(data, offs, width)
            row = np.searchsorted(offs, first, side="right") - 1
            sure, send = often.meet(hashes)
            out = np.zeros(len(place), dtype=PLACE)
            out["hash"], out["at"] = hashes, place - offs[row]
            for k, name in enumerate(("k1", "k2")):
                out[name] = batch.column(k).to_numpy()[row]
            _, inverse, count = np.unique(hashes, return_inverse=True, return_counts=True)
            tell = out[send]
            # what is sure goes to a bucket of its text; of these anchors only the number goes to the anchor's bucket
            tell["n"] = count[inverse][send]
            tell["at"][sure[send]] = -1
            out = out[sure]
            bucket = np.concatenate([tell["hash"] % np.uint64(buckets), np.uint64(buckets) + out["k1"].view(np.uint64) % np.uint64(buckets)])
            yield _packed("bucket", bucket.astype(np.int64), np.concatenate([tell, out]))
        left = np.flatnonzero(often.counts)
        out = np.zeros(len(left), dtype=PLACE)
        out["hash"], out["at"], out["n"] = often.values[left], -1, np.minimum(often.counts[left], 1 << 30)
        yield _packed("bucket", (out["hash"] % np.uint64(buckets)).astype(np.int64), out)

    @tk.releasing
    def twice(batches):
        """Places of anchors that occur twice; anchors that are hot come as a place -1 of a text named by their hash."""
        for held in _by_bucket(batches):
            records = np.frombuffer(b"".join(r[1] for r in held), dtype=PLACE)
            if held[0][0] < buckets:
                records = records[np.argsort(records["hash"], kind="stable")]
                head = np.flatnonzero(np.concatenate([[True], records["hash"][1:] != records["hash"][:-1]])) if len(records) else np.empty(0, np.int64)
                size = np.diff(np.append(head, len(records)))
                total = np.add.reduceat(records["n"].astype(np.int64), head) if len(head) else np.empty(0, np.int64)
                hot = np.zeros(int((total >= least_hot).sum()), dtype=PLACE)
                hot["k1"], hot["at"] = records["hash"][head[total >= least_hot]].view(np.int64), -1
                records = np.concatenate([records[np.repeat(total > 1, size) & (records["at"] >= 0)], hot])
            yield pa.RecordBatch.from_arrays([pa.array(records[c]) for c in ("k1", "k2", "at")], ["k1", "k2", "at"])

    total = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    # about two anchors for every string width
    expected = int(2 * total // (width - ANCHOR + 1))
    buckets = max(12, expected // BUCKET_ANCHORS + 1)
    least_hot = max(HOT, expected // HOT_MOST)
    found = docs.mapInArrow(elected, "bucket long, heads binary, bytes binary").repartition(2 * buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(twice, "k1 long, k2 long, at int")
    found = scratch.save(found, "found")
    # at most HOT_MOST, as each stands for so many of the expected places
    hot = np.sort(found.where("at = -1").select("k1").toArrow().column(0).to_numpy().view(np.uint64))
    sent_hot = sc.broadcast(hot)
    places = scratch.save(found.where("at >= 0").groupBy("k1", "k2").agg(F.collect_list("at").alias("places")), "places")
    amount = (places.agg(F.sum(F.size("places").cast("long"))).first()[0] or 0) * width * 3 // 2
    cells = max(12, int(amount // BUCKET_BYTES) + 1)

    def direct(key, start, stop):
        """Runs that need no other block."""
        out = np.zeros(len(start), dtype=HEAD)
        out["k1"], out["k2"], out["first"], out["count"] = key[0], key[1], start, stop - start
        return _packed("cell", 2 * cells + (out["k1"].view(np.uint64) % np.uint64(cells)).astype(np.int64), out)

    @tk.releasing
    def pieces(batches):
        often, hot = Often(), sent_hot.value
        for batch, data, offs in tk.slices(batches, "text", tk.BLOCK_BYTES):
            place, hashes, first, last = anchors(data, offs, width)
            row = np.searchsorted(offs, first, side="right") - 1
            lists = batch.column(3)
            wanted = lists.flatten().to_numpy() + np.repeat(offs[:-1], np.diff(lists.offsets.to_numpy()))
            keep = np.isin(place, wanted)
            place, hashes, first, last, row = place[keep], hashes[keep], first[keep], last[keep], row[keep]
            keys = [batch.column(k).to_numpy() for k in (0, 1)]
            many = np.isin(hashes, hot)
            if many.any():
                # strings of hot anchors one by one: those that a block or task has twice are settled, the first of each is dealt by its bytes
                start = ragged_index(first[many], (last - first + 1)[many])
                owner = np.repeat(row[many], (last - first + 1)[many])
                out = np.zeros(len(start), dtype=STRING)
                out["w1"], out["w2"] = tk.wide_hashes(data, start, start + width)
                out["k1"], out["k2"], out["first"] = keys[0][owner], keys[1][owner], start - offs[owner]
                sure, send = often.meet(out["w1"] ^ tk.mix(out["w2"]))
                out["n"] = np.where(sure, 2, 1)
                yield _packed("cell", cells + (out["w1"][send] % np.uint64(cells)).astype(np.int64), out[send])
                # runs of settled strings
                at = np.flatnonzero(sure)
                head = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 1) | (np.diff(start[at]) != 1) | (np.diff(owner[at]) != 0)])) if len(at) else np.empty(0, np.int64)
                stop = at[np.append(head[1:], len(at)) - 1] if len(at) else head
                one = out[at[head]]
                yield direct((one["k1"], one["k2"]), one["first"], out["first"][stop] + 1)
                place, hashes, first, last, row = (x[~many] for x in (place, hashes, first, last, row))
            size = last - first + width
            w1, w2 = tk.wide_hashes(data, first, first + size)
            cell = (tk.mix(hashes) % np.uint64(cells)).astype(np.int64)
            # equal pieces of a block stand together, and only the first sends its bytes
            order = np.lexsort((w2, w1, hashes, cell))
            place, hashes, first, last, row, size, w1, w2, cell = (x[order] for x in (place, hashes, first, last, row, size, w1, w2, cell))
            held = np.ones(len(order), dtype=bool)
            held[1:] = (hashes[1:] != hashes[:-1]) | (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1])
            out = np.zeros(len(order), dtype=HEAD)
            out["hash"], out["w1"], out["w2"], out["k1"], out["k2"], out["first"] = hashes, w1, w2, keys[0][row], keys[1][row], first - offs[row]
            out["count"], out["anchor"], out["size"], out["held"] = last - first + 1, place - first, size, held
            _, bucket, head, stop = _dealt(cell)
            text = data[ragged_index(first[held], size[held])]
            ends = np.concatenate([[0], np.cumsum(np.where(held, size, 0))])
            yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array([out[a:b].tobytes() for a, b in zip(head, stop)], pa.binary()), pa.array([text[ends[a] : ends[b]].tobytes() for a, b in zip(head, stop)], pa.binary())], ["cell", "heads", "bytes"])

    @tk.releasing
    def sorted_blocks(batches):
        for held in _by_bucket(batches):
            if held[0][0] >= 2 * cells:
                for _, heads, _ in held:
                    head = np.frombuffer(heads, dtype=HEAD)
                    yield from _runs_of(head, np.ones(int(head["count"].sum()), dtype=bool))
            elif held[0][0] >= cells:
                strings = np.frombuffer(b"".join(r[1] for r in held), dtype=STRING)
                strings = strings[np.lexsort((strings["w2"], strings["w1"]))]
                first = np.concatenate([[True], (strings["w1"][1:] != strings["w1"][:-1]) | (strings["w2"][1:] != strings["w2"][:-1])])
                total = np.add.reduceat(strings["n"], np.flatnonzero(first))
                found = strings[np.repeat(total > 1, np.diff(np.append(np.flatnonzero(first), len(strings)))) & (strings["n"] == 1)]
                yield pa.RecordBatch.from_arrays([pa.array(found[c]) for c in ("k1", "k2", "first", "first")], ["k1", "k2", "first", "last"])
            else:
                yield from sorted_cell([r[1] for r in held], [r[2] for r in held])

    def sorted_cell(heads, texts):
        head = np.frombuffer(b"".join(heads), dtype=HEAD)
        heads.clear()
        text = np.frombuffer(b"".join(texts), dtype=np.uint8)
        texts.clear()
        begin = np.cumsum(np.where(head["held"] > 0, head["size"], 0), dtype=np.int64)
        begin = np.concatenate([[0], begin[:-1]])
        # equal pieces of a bucket: each string of theirs repeats; one that holds its bytes stays for the others
        order = np.lexsort((1 - head["held"], head["w2"], head["w1"], head["hash"]))
        head, begin = head[order], begin[order]
        first = np.ones(len(head), dtype=bool)
        first[1:] = (head["hash"][1:] != head["hash"][:-1]) | (head["w1"][1:] != head["w1"][:-1]) | (head["w2"][1:] != head["w2"][:-1])
        copies = np.diff(np.append(np.flatnonzero(first), len(head)))
        flags_of = np.repeat(copies > 1, copies)
        yield from _runs_of(head[flags_of], np.ones(int(head["count"][flags_of].sum()), dtype=bool))
        one, at = head[first], begin[first]
        several = np.concatenate([[False], one["hash"][1:] == one["hash"][:-1]])
        several[:-1] |= several[1:]
        one, at, single = one[several], at[several], (copies == 1)[several]
        # one block of whole buckets at a time
        total = np.cumsum(one["size"], dtype=np.int64)
        edge = np.append(np.flatnonzero(np.concatenate([[True], one["hash"][1:] != one["hash"][:-1]])), len(one)) if len(one) else np.zeros(1, np.int64)
        low = 0
        while low < len(edge) - 1:
            high = low + 1
            while high < len(edge) - 1 and total[edge[high + 1] - 1] - (total[edge[low] - 1] if edge[low] else 0) <= block:
                high += 1
            a, b = edge[low], edge[high]
            low = high
            part = one[a:b]
            _, bucket = np.unique(part["hash"], return_inverse=True)
            # equal strings have equal distances to their anchors, so a large bucket is sorted by ranges of distances
            nearest, farthest = int((part["count"] - 1 - part["anchor"]).max()), int((-part["anchor"]).min())
            reach = nearest - farthest + 1
            if int(part["size"].sum()) > block:
                reach = max(1, block // len(part) - width)
            for near in range(farthest, nearest + 1, reach):
                begin_at = np.maximum(0, near + part["anchor"])
                stop_at = np.minimum(part["count"], near + reach + part["anchor"])
                some = np.flatnonzero(stop_at > begin_at)
                if len(some) < 2:
                    continue
                cut, skip = part[some].copy(), begin_at[some]
                cut["first"] += skip
                cut["anchor"] -= skip
                cut["count"] = (stop_at - begin_at)[some]
                flags = repeated_starts(text, at[a:b][some] + skip, cut["count"].astype(np.int64) - 1 + width, cut["anchor"].astype(np.int64), bucket[some], cut["count"].astype(np.int64), width)
                flags &= np.repeat(single[a:b][some], cut["count"])
                yield from _runs_of(cut, flags)

    def _runs_of(head, flags):
        if len(head):
            ends = np.concatenate([[0], np.cumsum(head["count"], dtype=np.int64)])
            start, stop = tk.runs(flags, ends)
            row = np.searchsorted(ends, start, side="right") - 1
            shift = head["first"][row] - ends[row]
            yield pa.RecordBatch.from_arrays([pa.array(head["k1"][row]), pa.array(head["k2"][row]), pa.array((start + shift).astype(np.int32)), pa.array((stop - 1 + shift).astype(np.int32))], ["k1", "k2", "first", "last"])

    # by a shuffle at every size: what is joined to the texts grows with them
    surrounded = docs.join(places, ["k1", "k2"]).select("k1", "k2", "text", "places")
    return surrounded.mapInArrow(pieces, "cell long, heads binary, bytes binary").repartition(3 * cells, "cell").sortWithinPartitions("cell").mapInArrow(sorted_blocks, "k1 long, k2 long, first int, last int")


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 200) -> DataFrame:
    """A row for each row of ``docs``: doc_id, n_bytes, spans (array of start, end: the maximal removed runs), kept binary."""
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "suffix")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # two hashes with different seeds name a text between steps
    texts = texts.withColumns({"k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit("second"), "text")})
    long = texts.where(f"octet_length(text) >= {width}")
    # texts that occur more than once, and of each one row that stays for the others
    kinds = long.select("k1", "k2", "text")
    again = scratch.save(kinds.groupBy("k1", "k2").agg(F.count("*").alias("n")).where("n > 1"), "again")
    copies = again.select("k1", "k2")
    copied = kinds.join(_small(copies), ["k1", "k2"]).groupBy("k1", "k2").agg(F.first("text").alias("text"))
    alone = kinds.join(_small(copies), ["k1", "k2"], "left_anti")
    runs = _repeats(alone.union(copied), width, scratch)
    spans = scratch.save(runs.groupBy("k1", "k2").agg(F.collect_list(F.struct("first", "last")).alias("runs")), "spans")
    scratch.drop("places", "found")
    whole = again.select("k1", "k2", F.lit(True).alias("all"))
    found = spans.join(whole, ["k1", "k2"], "full_outer").select("k1", "k2", "runs", F.coalesce("all", F.lit(False)).alias("all"))
    found = scratch.save(found, "removed")
    scratch.drop("spans")

    @tk.releasing
    def kept(batches):
        for batch, data, offs in tk.slices(batches, "text"):
            n = batch.num_rows
            spans, rest = [], []
            for i, (runs, everything) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                raw = data[offs[i] : offs[i + 1]]
                if everything and len(raw) >= width:
                    spans.append([{"start": 0, "end": len(raw)}]), rest.append(b"")
                    continue
                if not runs or len(raw) < width:
                    spans.append([]), rest.append(raw.tobytes())
                    continue
                edge = np.zeros(len(raw) + 1, dtype=np.int32)
                np.add.at(edge, [r["first"] for r in runs], 1)
                np.add.at(edge, [r["last"] + width for r in runs], -1)
                gone = np.cumsum(edge[:-1]) > 0
                a, b = tk.runs(gone, np.array([0, len(raw)]))
                spans.append([{"start": x, "end": y} for x, y in zip(a.tolist(), b.tolist())])
                rest.append(raw[~gone].tobytes())
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offs)), pa.array(spans, span), pa.array(rest, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    # copies of a text that is a large part of all rows are known by a table of bounded size and needn't be shuffled
    hot = again.where(F.col("n") * HOT_COPIES >= long.count()).select("k1", "k2", F.lit(True).alias("hot"))
    told = texts.join(F.broadcast(hot), ["k1", "k2"], "left")
    many = told.where("hot").select("doc_id", "text", F.lit(None).cast(dict(found.dtypes)["runs"]).alias("runs"), F.lit(True).alias("all"))
    keyed = told.where("hot is null").join(found, ["k1", "k2"], "left").select("doc_id", "text", "runs", "all").unionByName(many)
    return keyed.mapInArrow(kept, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
