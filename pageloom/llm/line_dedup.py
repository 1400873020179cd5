"""Operator 9. Line dedup by an exact set-similarity join.

A line is the set of its words (lower-cased A-Z). Words are ordered rarest first:
by the grade of a counter of their hash, then by hash; any
order gives right results; ours goes by counts of all texts. Equal sets are one class, of which the first line in
document order stays a candidate and is the only one in the index. Two lines match when
their Jaccard similarity reaches the threshold; then one word of each prefix is common
(prefix filter), and the sizes and the places of the first common word bound the overlap
(length and positional filters), as do the differing bits of two 128-bit parity bitmaps.
The index travels as packed arrays, dealt by word; a word that is frequent enough to fill
a task is dealt as blocks, every two of which meet. Candidates are verified on whole sets.
At 80 % a line of one to three different words matches only an equal set, so these go by class and
aren't indexed; one of four also matches the five that hold it. A line is removed if any earlier line matches it, judged on the input: for each line and
word the nearest candidates by bitmap are tried first, and all others only for lines that
are still open.

Defined cases: null texts and texts without lines of ``least_words`` different words (1, if nothing else
is asked for) stay as they are, as do shorter lines; rows with null id take no part and stay;
a document that had lines in the comparison and loses all of them is dropped if each
line it has left is blank or repeats the text of an earlier line, else it stays with them;
repeated rows are one document; rows that share an id share removals by line
number; columns other than id and text, whatever their names, pass through unchanged; an
empty table stays empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pageloom.llm import textkit as tk
from pageloom.llm.bpe import ragged_index
from pageloom.llm.textkit import wide_hashes
from pageloom.runtime import Scratch, ship

#: The order goes by counts of all words, kept in so many counters by hash (a byte each on every executor).
COUNTERS, PARTS = 1 << 20, 64
#: Up to so many documents (with what they list), classes or words a table is sent to all executors, some 20 MB; beyond, a shuffled join.
DOCS_SENT, CLASSES_SENT, WORDS_SENT = 1 << 20, 1 << 18, 1 << 20
#: Candidates tried first for a line and word; open lines sent to all executors at most.
TRIED, OPEN_SENT = 3, 1 << 18
#: Signatures of lines that a task remembers, so that a class sends its prefix rarely.
SEEN = 1 << 17
#: Records of an index bucket, on average; of a block of a hot word's list, and hot words at most (beyond, the blocks grow); pairs compared at once.
BUCKET_RECORDS, HOT, HOT_MOST, PAIRS_AT_ONCE = 200_000, 100_000, 1 << 20, 250_000
#: Records that a task holds before it deals them, and of a row at most (64 KB, so that no row is an object of its own in the heap).
DEALT_RECORDS, ROW_RECORDS = 1 << 16, 1489
#: Keys have 51 bits, so that with a line's number in a chunk they sort as one integer: 8 of a count on a log scale, 43 of a hash.
KEY_BITS, COUNT_BITS = 51, 8
CHUNK = 1 << (64 - KEY_BITS)
_MASK = np.uint64((1 << KEY_BITS) - 1)


def _counter(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(COUNTERS - 1)).astype(np.int64)


def _grade(counts: np.ndarray) -> np.ndarray:
    """Counts on a log scale of four steps an octave, in a byte."""
    return np.floor(4 * np.log2(np.maximum(counts, 1))).astype(np.uint8)


def _word_grades(docs: DataFrame, text_col: str) -> np.ndarray:
    """For each counter the grade of how often words with it occur in all texts; the driver gets a byte a counter."""
    wide = COUNTERS // PARTS

    @tk.releasing
    def count(batches):
        total = np.zeros(COUNTERS, dtype=np.int64)
        for _, data, offs in tk.slices(batches, text_col):
            low = tk.lower_ascii(data)
            total += np.bincount(_counter(tk.span_hashes(low, *tk.runs(tk.NOT_SPACE[low], offs))), minlength=COUNTERS)
        if total.any():
            small = np.minimum(total, (1 << 32) - 1).astype("<u4")
            for part in np.array_split(np.arange(PARTS), max(1, small.nbytes // tk.BATCH_BYTES)):
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([small[k * wide : (k + 1) * wide].tobytes() for k in part], pa.binary())], ["part", "counts"])

    @tk.releasing
    def graded(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                total[part] = total.get(part, 0) + np.frombuffer(blob.as_buffer(), dtype="<u4").astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([_grade(v).tobytes() for v in total.values()], pa.binary())], ["part", "grades"])

    got = docs.select(text_col).mapInArrow(count, "part long, counts binary").repartition(PARTS, "part").mapInArrow(graded, "part long, grades binary").toArrow()
    grades = np.zeros(COUNTERS, dtype=np.uint8)
    for part, blob in zip(got.column(0).to_pylist(), got.column(1).to_pylist()):
        grades[part * wide : (part + 1) * wide] = np.frombuffer(blob, dtype=np.uint8)
    return grades


def _lines(batches, text_col: str, grades: np.ndarray, least: int, short: bool = False):
    """Per slice, chunk by chunk: batch, and of its lines with enough different words: row, line number, sorted keys with bounds.
    With ``short`` also, per slice: batch, and of its other non-empty lines: row, line number, None, two hashes of the trimmed text."""
    for batch, data, offs in tk.slices(batches, text_col):
        low = tk.lower_ascii(data)
        starts, ends = tk.runs(tk.NOT_SPACE[low], offs)
        hashes = tk.span_hashes(low, starts, ends)
        # rarest first: the grade, then the hash
        keys = grades[_counter(hashes)].astype(np.uint64) << np.uint64(KEY_BITS - COUNT_BITS) | hashes >> np.uint64(64 - KEY_BITS + COUNT_BITS)
        breaks = np.flatnonzero(data == 10) + 1
        # a line begins with its row or after a break; breaks at a row's end begin an empty line there
        begin = np.concatenate([offs[:-1], breaks])
        row = np.concatenate([np.arange(len(offs) - 1), np.searchsorted(offs[1:], breaks - 1, side="right")])
        order = np.lexsort((begin, row))
        begin, row = begin[order], row[order]
        number = np.arange(len(row)) - np.searchsorted(row, np.arange(len(offs) - 1))[row]
        word_at = np.searchsorted(starts, begin, side="left")
        count = np.diff(np.append(word_at, len(starts)))
        few = count > 0
        full = np.flatnonzero(count >= least)
        for a in range(0, len(full), CHUNK):
            some = full[a : a + CHUNK]
            size = count[some]
            both = np.sort(np.repeat(np.arange(len(some), dtype=np.uint64) << np.uint64(KEY_BITS), size) | keys[ragged_index(word_at[some], size)])
            both = both[np.concatenate([[True], both[1:] != both[:-1]])]
            bounds = np.append(np.searchsorted(both, np.arange(len(some), dtype=np.uint64) << np.uint64(KEY_BITS)), len(both))
            n = np.diff(bounds)
            good = np.flatnonzero(n >= least)
            few[some[good]] = False
            flat = (both & _MASK)[ragged_index(bounds[good], n[good])]
            yield batch, row[some[good]], number[some[good]], flat, np.concatenate([[0], np.cumsum(n[good])])
        if short and few.any():
            few = np.flatnonzero(few)
            a, b = starts[word_at[few]], ends[word_at[few] + count[few] - 1]
            text = data[ragged_index(a, b - a)]
            stop = np.cumsum(b - a)
            yield batch, row[few], number[few], None, wide_hashes(text, stop - (b - a), stop)


def _ids(batch: pa.RecordBatch, row: np.ndarray) -> pa.Array:
    return batch.column(0).cast(pa.int64()).take(pa.array(row))


def _parity(flat: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 parity bits of each set: bit h is set if an odd number of its words hash to h. Two sets differ in as many words as bits, at least."""
    place = tk.mix(flat + np.uint64(0x5851F42D4C957F2D)) & np.uint64(127)
    bit = np.uint64(1) << (place & np.uint64(63))
    return tuple(np.bitwise_xor.reduceat(np.where(place >> np.uint64(6) == half, bit, np.uint64(0)), bounds[:-1]) for half in (np.uint64(0), np.uint64(1)))


def _line_key(doc_id: np.ndarray, line: np.ndarray) -> np.ndarray:
    """A hash of a line's place; equal hashes of different lines only add candidates."""
    return tk.mix(doc_id.astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15) + line.astype(np.int64).view(np.uint64)


def _small(df: DataFrame, lists: str | None = None) -> DataFrame:
    """``df`` marked for a broadcast if its rows, and what they list, are at most DOCS_SENT."""
    n, listed = df.agg(F.count("*"), F.sum(F.size(lists).cast("long")) if lists else F.lit(0)).first()
    return F.broadcast(df) if n + max(listed or 0, 0) <= DOCS_SENT else df


ENDS = ["a_doc", "a_line", "b_doc", "b_line"]
RECORD = np.dtype([("token", "<u8"), ("doc_id", "<i8"), ("b1", "<u8"), ("b2", "<u8"), ("line", "<i4"), ("n", "<i4"), ("pos", "<i4")])


def _dealt(records: np.ndarray, buckets: int):
    """Batches (bucket, records) of packed records by the hash of their word: rows of ROW_RECORDS at most, batches of about BATCH_BYTES."""
    bucket = (tk.mix(records["token"]) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    records, bucket = records[order], bucket[order]
    change = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    parts = -(-np.diff(np.append(change, len(bucket))) // ROW_RECORDS)
    head = np.repeat(change, parts) + ROW_RECORDS * ragged_index(np.zeros(len(parts), np.int64), parts)
    stop = np.append(head[1:], len(bucket))
    low = 0
    while low < len(head):
        high = max(low + 1, int(np.searchsorted(stop, head[low] + tk.BATCH_BYTES // RECORD.itemsize, side="right")))
        yield pa.RecordBatch.from_arrays([pa.array(bucket[head[low:high]]), pa.array([records[a:b].tobytes() for a, b in zip(head[low:high], stop[low:high])], pa.binary())], ["bucket", "records"])
        low = high


def _pairs_of(records: np.ndarray, percent: int, only: np.ndarray | None, every: bool, tried: int, at_once: int):
    """Candidates (records, a, b, more), b the later line, of packed records: of each list (equal token) and later line the ``tried`` with
    the fewest differing bits (more: there were others), or all of the later lines whose key is in ``only``, or all of all."""
    records = records[np.lexsort((records["line"], records["doc_id"], records["token"]))]
    change = np.flatnonzero(np.concatenate([[True], records["token"][1:] != records["token"][:-1]]))
    size = np.diff(np.append(change, len(records)))
    start, at = np.repeat(change, size), np.arange(len(records))
    # each record against the records before it in its list, a bounded number of pairs at once
    before = at - start
    if only is not None:
        before = np.where(np.isin(_line_key(records["doc_id"], records["line"]), only), before, 0)
    todo = np.flatnonzero(before)
    sums = np.cumsum(before[todo])
    size_of, pos_of = records["n"].astype(np.int64), records["pos"].astype(np.int64)
    b1, b2 = records["b1"].copy(), records["b2"].copy()
    low = 0
    while low < len(todo):
        high = max(low + 1, int(np.searchsorted(sums, (sums[low - 1] if low else 0) + at_once)))
        some = todo[low:high]
        low = high
        b = np.repeat(some, before[some])
        a = ragged_index(start[some], before[some])
        n, m = size_of[a], size_of[b]
        # at the first common word of two sets the overlap is what is left of either, at most
        least = -(-percent * (n + m) // (100 + percent))
        good = np.minimum(n - pos_of[a], m - pos_of[b]) >= least
        a, b, most = a[good], b[good], (n + m - 2 * least)[good]
        # differing words are at most n + m - 2 * the least overlap
        bits = np.bitwise_count(b1[a] ^ b1[b]).astype(np.int64)
        good = np.flatnonzero(bits <= most)
        a, b, most, bits = a[good], b[good], most[good], bits[good]
        bits += np.bitwise_count(b2[a] ^ b2[b])
        good = bits <= most
        good &= (records["doc_id"][a] != records["doc_id"][b]) | (records["line"][a] != records["line"][b])
        a, b, bits = a[good], b[good], bits[good]
        if not len(a):
            continue
        if only is not None or every:
            yield records, a, b, np.zeros(len(a), dtype=bool)
            continue
        order = np.lexsort((a, bits, b))
        a, b = a[order], b[order]
        head = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
        count = np.diff(np.append(head, len(b)))
        keep = np.arange(len(b)) - np.repeat(head, count) < tried
        yield records, a[keep], b[keep], np.repeat(count > tried, count)[keep]


def _common(left: pa.Array, right: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of two columns of packed sorted sets: sizes of the rows' intersections, and sums of their sizes."""
    x, x_bounds = tk.binary_values(left, np.uint64)
    y, y_bounds = tk.binary_values(right, np.uint64)
    common = np.zeros(len(left), dtype=np.int64)
    for low in range(0, len(left), CHUNK):
        high = min(low + CHUNK, len(left))
        rows = np.arange(high - low, dtype=np.uint64) << np.uint64(KEY_BITS)
        p, q = (np.repeat(rows, np.diff(o[low : high + 1])) | v[o[low] : o[high]] for v, o in ((x, x_bounds), (y, y_bounds)))
        at = np.minimum(np.searchsorted(p, q), len(p) - 1)
        common[low:high] = np.bincount((q[p[at] == q] >> np.uint64(KEY_BITS)).astype(np.int64), minlength=high - low)
    return common, np.diff(x_bounds) + np.diff(y_bounds)


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, least_words: int = 1) -> DataFrame:
    """Of each document that loses lines: doc_id, the numbers (from 0) of those that match an earlier one, and whether it stays: a compared line
    is left, or a shorter one whose trimmed text no earlier line has."""
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "lines")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null and text is not null")
    grades = _word_grades(docs, "text")
    sent = spark.sparkContext.broadcast(grades)
    seen_most = SEEN

    def needed(n):
        return -(-percent * n // 100)

    @tk.releasing
    def with_prefixes(batches):
        # the earliest line of each class so far; rows may come in any order, so a class's first line gets its prefix wherever it is read
        seen: dict[bytes, int] = {}
        for batch, row, number, flat, bounds in _lines(batches, "text", sent.value, least_words, short=True):
            if not len(row):
                continue
            if flat is None:
                nothing, zero = pa.array([b""] * len(row), pa.binary()), pa.array(np.zeros(len(row), np.int64))
                columns = [_ids(batch, row), pa.array(number.astype(np.int32)), zero.cast(pa.int32()), *(pa.array(h.view(np.int64)) for h in bounds), zero, zero, nothing]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "line", "n", "s1", "s2", "b1", "b2", "prefix"])
                continue
            n = np.diff(bounds)
            ids = _ids(batch, row)
            one = np.add.reduceat(tk.mix(flat * np.uint64(0x9E3779B97F4A7C15)), bounds[:-1]).view(np.int64)
            two = np.add.reduceat(tk.mix(flat ^ np.uint64(0xC2B2AE3D27D4EB4F)), bounds[:-1]).view(np.int64)
            new = np.zeros(len(row), dtype=bool)
            # a set so small that a word more or less is too much matches equal sets only: its class is all it needs
            meets = np.flatnonzero((100 * n >= percent * (n + 1)) | (100 * (n - 1) >= percent * n))
            # 16 bytes less the zeros at their end: different signatures stay different
            sigs = np.stack([one[meets], two[meets]], axis=1).view("S16").ravel().tolist()
            for i, sig, doc, line in zip(meets.tolist(), sigs, ids.to_numpy()[meets].tolist(), number[meets].tolist()):
                place, first = (doc << 32) + line, seen.get(sig)
                if first is None or place < first:
                    new[i] = True
                    if len(seen) >= seen_most:
                        seen.clear()
                    seen[sig] = place
            size = np.where(new, n - needed(n) + 1, 0)
            prefix = tk.ragged_binary(flat[ragged_index(bounds[:-1], size)], np.concatenate([[0], np.cumsum(size)]))
            b1, b2 = (np.where(new, x, np.uint64(0)).view(np.int64) for x in _parity(flat, bounds))
            columns = [ids, pa.array(number.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(one), pa.array(two), pa.array(b1), pa.array(b2), prefix]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "line", "n", "s1", "s2", "b1", "b2", "prefix"])

    rows = scratch.save(docs.mapInArrow(with_prefixes, "doc_id long, line int, n int, s1 long, s2 long, b1 long, b2 long, prefix binary"), "rows")
    # classes of several lines, with their first one; other lines of enough words (n > 0) are classes of their own
    several = rows.groupBy("s1", "s2").agg(F.count("*").alias("copies")).where("copies > 1").select("s1", "s2")
    several = scratch.save(several, "several")
    several = F.broadcast(several) if several.count() <= CLASSES_SENT else several
    again = rows.select("doc_id", "line", "s1", "s2").join(several, ["s1", "s2"]).groupBy("s1", "s2").agg(F.min(F.struct("doc_id", "line")).alias("node"))
    again = scratch.save(again, "again")
    again = F.broadcast(again) if again.count() <= CLASSES_SENT else again
    first = rows.where("octet_length(prefix) > 0").join(again, ["s1", "s2"], "left").where("node is null or struct(doc_id, line) = node")
    first = first.select("doc_id", "line", "n", "b1", "b2", "prefix")
    tokens = rows.agg(F.sum(F.octet_length("prefix") / 8)).first()[0] or 0
    buckets = max(12, int(-(-tokens // BUCKET_RECORDS)))

    # words whose list would fill a task, counted in the prefixes; only grades that allow for it are looked at
    most = max(HOT, int(tokens) // HOT_MOST)
    grade = int(_grade(np.array([most]))[0])
    hot_words, blocks = np.empty(0, np.uint64), np.empty(0, np.int64)
    if len(grades) and int(grades.max()) >= grade:

        @tk.releasing
        def graded(batches):
            for batch in batches:
                word, c = np.unique(tk.binary_values(batch.column(0), np.uint64)[0], return_counts=True)
                some = word >> np.uint64(KEY_BITS - COUNT_BITS) >= np.uint64(grade)
                yield pa.RecordBatch.from_arrays([pa.array(word[some].view(np.int64)), pa.array(c[some])], ["word", "c"])

        hot = first.select("prefix").mapInArrow(graded, "word long, c long").groupBy("word").agg(F.sum("c").alias("c")).where(f"c > {most}").orderBy("word").toArrow()
        hot_words, blocks = hot.column(0).to_numpy().view(np.uint64), -(-hot.column(1).to_numpy() // most)

    def index(words: np.ndarray | None) -> DataFrame:
        """Packed records of all prefixes, or of those with a word of ``words`` (sorted), dealt by word."""
        chosen = spark.sparkContext.broadcast(words)

        @tk.releasing
        def packed(batches):
            held, n_held, words = [], 0, chosen.value

            for batch in batches:
                token, bounds = tk.binary_values(batch.column(5), np.uint64)
                size = np.diff(bounds)
                out = np.zeros(len(token), dtype=RECORD)
                out["token"], out["pos"] = token, np.arange(len(token)) - np.repeat(bounds[:-1], size)
                for k, name in enumerate(("doc_id", "line", "n", "b1", "b2")):
                    out[name] = np.repeat(batch.column(k).to_numpy().astype(RECORD[name]), size)
                if words is not None:
                    out = out[np.isin(out["token"], words)]
                hot = np.flatnonzero(np.isin(out["token"], hot_words)) if len(blocks) else np.empty(0, np.int64)
                if len(hot):
                    # a record of a hot word meets every block of that word: its token becomes that of each pair of blocks
                    parts = blocks[np.searchsorted(hot_words, out["token"][hot])]
                    copies = out[np.repeat(hot, parts)]
                    mine = (tk.mix(copies["doc_id"].view(np.uint64) ^ copies["line"].astype(np.uint64)) % np.repeat(parts, parts).astype(np.uint64)).astype(np.int64)
                    other = ragged_index(np.zeros(len(hot), np.int64), parts)
                    cell = np.minimum(mine, other) * (1 << 20) + np.maximum(mine, other)
                    copies["token"] = tk.mix(copies["token"] * np.uint64(31) + cell.astype(np.uint64))
                    out = np.concatenate([np.delete(out, hot), copies])
                if len(out):
                    held.append(out)
                    n_held += len(out)
                if n_held > DEALT_RECORDS:
                    yield from _dealt(np.concatenate(held), buckets)
                    held, n_held = [], 0
            if held:
                yield from _dealt(np.concatenate(held), buckets)

        return first.mapInArrow(packed, "bucket long, records binary").repartition(buckets, "bucket").sortWithinPartitions("bucket")

    def candidates(only: np.ndarray | None, every: bool, words: np.ndarray | None) -> DataFrame:
        chosen, tried_first, at_once = spark.sparkContext.broadcast(only), TRIED, PAIRS_AT_ONCE

        @tk.releasing
        def found(batches):
            def emit(held):
                records = np.frombuffer(b"".join(held), dtype=RECORD)
                held.clear()
                pairs = _pairs_of(records, percent, chosen.value, every, tried_first, at_once)
                del records  # it goes on with a sorted copy
                for r, a, b, more in pairs:
                    ends = [pa.array(r[c][x]) for x in (a, b) for c in ("doc_id", "line")]
                    yield pa.RecordBatch.from_arrays([*ends, pa.array(more)], [*ENDS, "more"])

            now, held = None, []
            for batch in batches:
                for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if bucket != now:
                        if held:
                            yield from emit(held)
                        now, held = bucket, []
                    held.append(blob)
            if held:
                yield from emit(held)

        pairs = index(words).mapInArrow(found, "a_doc long, a_line int, b_doc long, b_line int, more boolean")
        return pairs.groupBy(*ENDS).agg(F.max("more").alias("more"))

    def whole(ids: DataFrame) -> DataFrame:
        """(doc, line, blob) of the lines in ``ids(doc, line)``."""
        wanted = ids.groupBy("doc").agg(F.collect_set("line").alias("wanted"))
        wanted = _small(wanted, "wanted")

        @tk.releasing
        def pick(batches):
            for batch, row, number, flat, bounds in _lines(batches, "text", sent.value, least_words):
                lists = batch.column(2)
                wanted = _line_key(np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy())
                at = np.flatnonzero(np.isin(_line_key(row, number), wanted))
                n = np.diff(bounds)[at]
                yield pa.RecordBatch.from_arrays([_ids(batch, row[at]), pa.array(number[at].astype(np.int32)), tk.ragged_binary(flat[ragged_index(bounds[at], n)], np.concatenate([[0], np.cumsum(n)]))], ["doc", "line", "blob"])

        return docs.withColumnRenamed("doc_id", "doc").join(wanted, "doc").select("doc", "text", "wanted").mapInArrow(pick, "doc long, line int, blob binary")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        """(doc_id, line) of the later lines (b) of those of ``pairs`` that match."""
        ends = [pairs.select(F.col(f"{x}_doc").alias("doc"), F.col(f"{x}_line").alias("line")) for x in "ab"]
        sets = scratch.save(whole(ends[0].union(ends[1])), f"sets_{name}")
        of = {x: sets.select(F.col("doc").alias(f"{x}_doc"), F.col("line").alias(f"{x}_line"), F.col("blob").alias(f"{x}_blob")) for x in "ab"}
        both = pairs.join(of["b"], ["b_doc", "b_line"]).join(of["a"], ["a_doc", "a_line"])

        @tk.releasing
        def check(batches):
            for batch in batches:
                common, sizes = _common(batch.column(2), batch.column(3))
                yield batch.select([0, 1]).filter(pa.array((100 + percent) * common >= percent * sizes))

        matched = both.select(F.col("b_doc").alias("doc_id"), F.col("b_line").alias("line"), "b_blob", "a_blob").mapInArrow(check, "doc_id long, line int").distinct()
        matched = scratch.save(matched, f"matched_{name}")
        scratch.drop(f"sets_{name}")
        return matched

    tried = scratch.save(candidates(None, False, None), "tried")
    matched = verified(tried.select(*ENDS), "tried")
    left = scratch.save(tried.where("more").select(F.col("b_doc").alias("doc_id"), F.col("b_line").alias("line")).distinct().join(matched, ["doc_id", "line"], "left_anti"), "open")
    n_left = left.count()
    if n_left:
        # few enough, they are sent to all executors, with their words; else all lines list every candidate, and a join keeps the open ones
        if n_left <= OPEN_SENT:
            place = left.toArrow()
            only = np.unique(_line_key(*(place.column(k).to_numpy() for k in range(2))))

            @tk.releasing
            def words_of(batches):
                for batch in batches:
                    yield pa.RecordBatch.from_arrays([pa.array(np.unique(tk.binary_values(batch.column(0), np.int64)[0]))], ["word"])

            words = scratch.save(first.join(F.broadcast(left), ["doc_id", "line"]).select("prefix").mapInArrow(words_of, "word long").distinct(), "words")
            known = np.sort(words.toArrow().column(0).to_numpy().view(np.uint64)) if words.count() <= WORDS_SENT else None
            rest = candidates(only, False, known)
        else:
            rest = candidates(None, True, None).join(left.select(F.col("doc_id").alias("b_doc"), F.col("line").alias("b_line")), ["b_doc", "b_line"], "left_semi")
        rest = scratch.save(rest.select(*ENDS).join(tried.select(*ENDS), ENDS, "left_anti"), "rest")
        matched = matched.union(verified(rest, "rest"))
    scratch.drop("tried")

    copies = rows.select("doc_id", "line", "n", "s1", "s2").join(again, ["s1", "s2"]).where("struct(doc_id, line) <> node")
    copies = scratch.save(copies.select("doc_id", "line", "n"), "copies")
    gone = copies.where("n > 0").select("doc_id", "line").union(matched).groupBy("doc_id").agg(F.sort_array(F.collect_set("line")).alias("removed"))
    gone = scratch.save(gone, "gone")
    # documents that keep a compared line, or else a short one that no earlier line has
    few = _small(gone, "removed")
    some = scratch.save(rows.where("n > 0").select("doc_id", "line").join(few, "doc_id").where("not array_contains(removed, line)").select("doc_id").distinct(), "some")
    emptied = scratch.save(gone.select("doc_id").join(some, "doc_id", "left_anti"), "emptied")
    emptied = _small(emptied)
    short = rows.where("n = 0").select("doc_id", "line").join(emptied, "doc_id", "left_semi").join(copies.where("n = 0").select("doc_id", "line"), ["doc_id", "line"], "left_anti")
    own = some.union(short.select("doc_id")).distinct().withColumn("own", F.lit(True))
    return gone.join(own, "doc_id", "left").select("doc_id", "removed", F.col("own").isNotNull().alias("stays"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, least_words: int = 1) -> DataFrame:
    """``docs`` with the same columns: texts without lines that match an earlier one, documents of which only repeats of earlier lines are left dropped."""
    scratch = Scratch(docs.sparkSession, "removed")
    found = scratch.save(removed_lines(docs, id_col, text_col, percent, least_words), "removed")
    found = _small(found, "removed")
    # the document travels as one column, so no name of its own can clash
    nested = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), F.col(f"`{id_col}`").cast("long").alias("doc_id"))
    joined = nested.join(found, "doc_id", "left").where("removed is null or stays")
    text = f"doc.`{text_col}`"
    kept = F.expr(f"case when removed is null then {text} else array_join(filter(split({text}, '\\n', -1), (x, i) -> not array_contains(removed, i)), '\\n') end")
    return joined.select(*((kept if c == text_col else F.col(f"doc.`{c}`")).alias(c) for c in docs.columns))
