"""Similarity self-join of documents on the Jaccard index of their word shingles, to components.

Rare-first prefix filtering: shingles are ordered by their frequency in the corpus, rarest first.
Two sets that overlap enough share a shingle within short prefixes of that order, so only prefixes are
shuffled. The frequencies come from a table of counters that grows with the input: any order
common to all documents finds every pair, and shingles that many documents share come last.

Documents with equal sets form one class and only its first row takes part. The postings of one
shingle are not expanded into all pairs: first each is compared with the most central one of the list
(the one with the fewest rarer shingles before), linked documents are merged into components, and
then only pairs of different components are compared. Such pairs pass the length and the
positional filter, are made distinct, pass the suffix filter on the partitioned sets and are verified once.
The suffix filter bounds the overlap by 256 ranges of the hashes at once instead of halving by halves.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbra.llm.common import arrow_batches, join_by_group, slices, staged, text_of, without
from umbra.llm.components import components
from umbra.llm.hashing import mixed, word_codes

#: Shingles for each counter of the frequency table, and the table's size in bits at least and at most.
COUNTER_SHINGLES, TABLE_BITS = 64, (10, 21)
#: Counters are compared by levels, this many for each doubling, so the table is one byte a counter.
LEVELS = 5
#: Counters that travel together when Spark sums the table.
CHUNK = 1 << 10
#: A list of postings with more pairs of different components than this meets its centre first.
DENSE_PAIRS = 512
#: Lists of more postings are met in parts; so are, from the second round on, the lists of a component, in parts of about so many rows.
PART_ROWS, MAIN_ROWS = 50_000, 2_048
_MULTIPLIERS = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64
)


def shingle_hashes(texts: pa.Array, width: int = 5) -> list[np.ndarray]:
    """The distinct shingles of each text as sorted 64-bit hashes; fewer words than ``width`` are one shingle."""
    codes, counts = word_codes(texts)
    places = np.array([pow(int(_MULTIPLIERS[i % 5]), i // 5 + 1, 1 << 64) for i in range(width)], np.uint64)
    full = np.zeros(max(len(codes) - width + 1, 0), np.uint64)
    for i in range(width):
        full += codes[i : i + len(full)] * places[i]
    mixed(full)
    out, at = [], 0
    for n in counts.tolist():
        if n >= width:
            hashes = np.sort(full[at : at + n - width + 1])
            out.append(hashes[np.append(True, hashes[1:] != hashes[:-1])])
        elif n:
            short = (codes[at : at + n] * places[:n]).sum(dtype=np.uint64, keepdims=True) + np.uint64(n)
            out.append(mixed(short))
        else:
            out.append(np.empty(0, np.uint64))
        at += n
    return out


SETS = "row long, doc_id long, n long, sig_a long, sig_b long, hashes binary, digest binary"


def digest_of() -> Column:
    """SHA-256 of the text; with the doc_id it tells rows apart that are not equal."""
    return F.unhex(F.sha2(text_of(), 256))


def shingle_sets(docs: DataFrame, width: int = 5) -> DataFrame:
    """A row per document: its number, set size, signature of the set, the sorted hashes as bytes, and the digest of the text."""
    schema = pa.schema([(c.split()[0], pa.binary() if c.endswith("binary") else pa.int64()) for c in SETS.split(", ")])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in slices(batches, 256):
            sets = shingle_hashes(batch.column(2), width)
            packed = [s.tobytes() for s in sets]
            signs = np.frombuffer(b"".join([xxhash.xxh3_128_digest(p) for p in packed]), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(signs[:, 0]), pa.array(signs[:, 1]), pa.array(packed, pa.binary()), batch.column(3)],
                schema=schema,
            )

    source = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"), digest_of().alias("digest")
    )
    return source.mapInArrow(rows, SETS)


def bucket_of(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def level_of(counts: np.ndarray) -> np.ndarray:
    """Counters as levels of one byte, ``LEVELS`` for each doubling, rounded up."""
    return np.ceil(LEVELS * np.log2(counts.astype(np.float64) + 1)).astype(np.uint8)


def frequency_table(sets: DataFrame, total: int) -> np.ndarray:
    """The levels of 2**bits counters of all ``total`` shingles of all sets, summed by Spark; a counter has ``COUNTER_SHINGLES`` on average.

    Beyond 2**``TABLE_BITS[1]`` counters each has more of them. A counter is never less than the frequency of a shingle that it counts.
    """
    bits = min(max(ceil(log2(max(total / COUNTER_SHINGLES, 1))), TABLE_BITS[0]), TABLE_BITS[1])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, waiting = np.zeros(1 << bits, np.uint32), []

        def add() -> None:
            if waiting:
                np.add(counts, np.bincount(np.concatenate(waiting), minlength=1 << bits), out=counts, casting="unsafe")
                waiting.clear()

        for batch in slices(batches):
            waiting.append(bucket_of(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint64), bits))
            if sum(map(len, waiting)) >= 1 << bits:
                add()
        add()
        parts = counts.reshape(-1, CHUNK)
        there = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array([zlib.compress(parts[i].tobytes(), 1) for i in there], pa.binary())], names=["chunk", "counts"])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, packed in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                sums[chunk] = sums.get(chunk, 0) + np.frombuffer(zlib.decompress(packed), np.uint32).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(sums.keys(), pa.int64()), pa.array([level_of(x).tobytes() for x in sums.values()], pa.binary())], names=["chunk", "counts"])

    counted = sets.select("hashes").mapInArrow(count, "chunk long, counts binary")
    out = np.zeros(((1 << bits) // CHUNK, CHUNK), np.uint8)
    for row in counted.repartition("chunk").mapInArrow(add_up, "chunk long, counts binary").toArrow().to_pylist():
        out[row["chunk"]] = np.frombuffer(row["counts"], np.uint8)
    return out.ravel()


def prefix_postings(classes: DataFrame, table: np.ndarray, num: int, den: int, part_rows: int) -> DataFrame:
    """(row, n, tokens, long): the first shingles, rarest first, of every class, and those among them that more than ``part_rows`` may hold."""
    bits = table.size.bit_length() - 1
    shared = classes.sparkSession.sparkContext.broadcast(table)
    most = int(level_of(np.array([part_rows]))[0])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = shared.value

        def listed(parts: list[np.ndarray]) -> pa.ListArray:
            ends = np.cumsum([0, *map(len, parts)])
            return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int64), *parts])))

        for batch in slices(batches):
            tokens, long = [], []
            for packed in batch.column(2).to_pylist():
                hashes = np.frombuffer(packed, np.uint64)
                n = len(hashes)
                # hashes are sorted, so a stable sort orders by (level, hash)
                level = levels[bucket_of(hashes, bits)]
                order = np.argsort(level, kind="stable")[: n - -(-num * n // den) + 1]
                tokens.append(hashes[order].view(np.int64))
                long.append(tokens[-1][level[order] > most])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), listed(tokens), listed(long)], names=["row", "n", "tokens", "long"])

    return classes.select("row", "n", "hashes").mapInArrow(cut, "row long, n long, tokens array<long>, long array<long>")


def long_lists(cut: DataFrame, part_rows: int) -> DataFrame:
    """(token, parts) of the lists of more than ``part_rows`` postings, by their exact lengths."""
    counts = cut.select(F.explode("long").alias("token")).groupBy("token").agg(F.count("*").alias("m"))
    return counts.where(F.col("m") > part_rows).select("token", F.ceil(F.col("m") / part_rows).cast("int").alias("parts"))


def spread(cut: DataFrame, table: np.ndarray, part_rows: int, broadcast_rows: int = 500_000) -> DataFrame:
    """(token, row, place, salt) of all postings; place is n * 2**32 + position. Lists of more than ``part_rows`` are dealt to salts, all others have -1."""
    place = F.shiftleft("n", 32) + F.col("pos")
    postings = cut.select("row", "n", F.posexplode("tokens").alias("pos", "token")).select("token", "row", place.alias("place"))
    if int(table.max(initial=0)) <= int(level_of(np.array([part_rows]))[0]):  # no counter, so no list, is that long
        return postings
    parts = staged(long_lists(cut, part_rows))
    small = parts.count() <= broadcast_rows
    salt = F.coalesce(F.pmod(F.xxhash64("row"), F.col("parts")).cast("int"), F.lit(-1))
    return postings.join(F.broadcast(parts) if small else parts, "token", "left").withColumn("salt", salt).drop("parts")


_FOUND = "token long, row long, place long, other long"
_TOKEN, _ROW, _PLACE, _SALT, _COMP = range(5)  # columns of the postings within a task


def meet(postings: DataFrame, num: int, den: int, dense: int | None) -> DataFrame:
    """Goes through the lists of postings (token, row, place and, if any, salt and comp), each sorted by size.

    Gives pairs (row, other) of different components to verify: all that pass the filters in lists of at
    most ``dense`` pairs (None: in all), else those of the list's most central row with the others. The
    postings of such lists come back as well (other is null), as they are not settled by it, and so
    does one that is alone in a part of a list that ``spread`` has split: it met none of the other parts.
    """

    def linkable(n_a, pos_a, n_b, pos_b):
        """Length and positional filter of pairs with n_a <= n_b at a shared token, which must lie in a's index prefix."""
        index = n_a - -(-2 * num * n_a // (num + den)) + 1
        need = -(-num * (n_a + n_b) // (num + den))
        return (den * n_a >= num * n_b) & (pos_a < index) & (np.minimum(n_a - pos_a, n_b - pos_b) >= need)

    def parts(run: np.ndarray):
        """Row, component (at first the row itself), set size and position of postings."""
        row, place = run[..., _ROW], run[..., _PLACE]
        return row, run[..., _COMP] if run.shape[-1] > _COMP else row, place >> 32, place & 0xFFFFFFFF

    def meeting(row, comp, n, pos) -> np.ndarray:
        """The pairs of [list, member] arrays, sorted by size, that pass the filters."""
        i, j = np.triu_indices(row.shape[1], 1)
        fits = linkable(n[:, i], pos[:, i], n[:, j], pos[:, j]) & (comp[:, i] != comp[:, j])
        return np.column_stack([row[:, i][fits], row[:, j][fits]])

    def all_pairs(run: np.ndarray) -> Iterator[np.ndarray]:
        """The same of one list, however long, a member at a time."""
        row, comp, n, pos = parts(run)
        for j in range(1, len(run)):
            least = np.searchsorted(n[:j], -(-num * n[j] // den))
            fits = linkable(n[least:j], pos[least:j], n[j], pos[j]) & (comp[least:j] != comp[j])
            other = row[least:j][fits]
            yield np.column_stack([other, np.full(len(other), row[j])])

    def stars(starts: np.ndarray, lengths: np.ndarray, table: np.ndarray) -> np.ndarray:
        """The pairs (centre, member) of the given lists that may link by their lengths; the centre has the least position, then size and row."""
        number = np.repeat(np.arange(len(starts)), lengths)
        at = np.arange(len(number)) + np.repeat(starts - np.cumsum(lengths) + lengths, lengths)
        row, comp, n, pos = parts(table[at])
        centre = np.lexsort((row, n, pos, number))[np.cumsum(lengths) - lengths][number]
        fits = (den * np.minimum(n, n[centre]) >= num * np.maximum(n, n[centre])) & (comp != comp[centre])
        return np.column_stack([row[centre][fits], row[fits]])

    def lists(table: np.ndarray) -> Iterator[pa.RecordBatch]:
        ends = np.concatenate([np.flatnonzero(changed(table[1:], table[:-1])) + 1, [len(table)]])
        starts = np.concatenate([[0], ends[:-1]])
        lengths = ends - starts
        comp = parts(table)[1]
        several = np.maximum.reduceat(comp, starts) != np.minimum.reduceat(comp, starts)
        dense_ones = several & (lengths * (lengths - 1) // 2 > (np.inf if dense is None else dense))
        short, long = several & ~dense_ones & (lengths <= 64), several & ~dense_ones & (lengths > 64)
        pairs = [np.empty((0, 2), np.int64)]
        if dense_ones.any():
            pairs.append(stars(starts[dense_ones], lengths[dense_ones], table))
        for m in np.unique(lengths[short]).tolist():
            some = starts[short & (lengths == m)]
            step = max(1, 500_000 // (m * m))
            for k in range(0, len(some), step):
                pairs.append(meeting(*parts(table[some[k : k + step, None] + np.arange(m)])))
        for i in np.flatnonzero(long):
            pairs += all_pairs(table[starts[i] : ends[i]])
        pairs = np.concatenate(pairs) if dense == 0 else fresh(np.sort(np.concatenate(pairs), axis=1))
        none = np.zeros(len(pairs), np.int64)
        yield batch_of(none, pairs[:, 0], none, pa.array(pairs[:, 1]))
        open_lists = dense_ones
        if dense == 0 and table.shape[1] > _SALT:
            open_lists = open_lists | ((lengths == 1) & (table[starts, _SALT] >= 0))
        if open_lists.any():
            runs = table[np.repeat(open_lists, lengths)]
            yield batch_of(runs[:, _TOKEN], runs[:, _ROW], runs[:, _PLACE], pa.nulls(len(runs), pa.int64()))

    met: list[np.ndarray] = []  # pairs that this task has given, as lists of one component share many

    def fresh(pairs: np.ndarray) -> np.ndarray:
        """The distinct pairs that were not given before; forgets when it holds too many, as they are made distinct later."""
        pair = np.dtype([("a", np.int64), ("b", np.int64)])
        new = np.unique(np.ascontiguousarray(pairs).view(pair).ravel())
        if met:
            new = new[~np.isin(new, met[0])]
        known = np.sort(np.concatenate([*met, new]))
        met[:] = [known] if len(known) < 1_000_000 else []
        return new.view(np.int64).reshape(-1, 2)

    def batch_of(token, row, place, other) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*map(pa.array, (token, row, place)), other], names=["token", "row", "place", "other"])

    def changed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Where two rows are of different lists."""
        same = a[..., _TOKEN] == b[..., _TOKEN]
        return ~(same & (a[..., _SALT] == b[..., _SALT])) if a.shape[-1] > _SALT else ~same

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # the last list, which may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            table = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])
            last = np.flatnonzero(changed(table, table[-1]))
            if not len(last) and held and not changed(held[0][0], table[0]):
                held.append(table)
                continue
            cut = last[-1] + 1 if len(last) else 0
            done = np.concatenate([*held, table[:cut]])
            held = [table[cut:]]
            if len(done):
                yield from lists(done)
        if held:
            yield from lists(np.concatenate(held))

    dealt = postings.select("token", "row", "place", *(c for c in ("salt", "comp", "main") if c in postings.columns))
    # later on, all lists of one main component meet in one task (or its parts), which gives their pairs once
    keys = ["main", "salt"] if "main" in dealt.columns else ["token", *(["salt"] if "salt" in dealt.columns else [])]
    tasks = int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # fixed, as these rows cost more than their bytes tell
    return dealt.repartition(tasks, *keys).sortWithinPartitions(*keys, "token", "place", "row").mapInArrow(scan, _FOUND)


def among(rows: DataFrame, ids: DataFrame, how: str, broadcast_rows: int = 2_000_000) -> DataFrame:
    """Semi or anti join with a staged table of row ids, broadcast only up to ``broadcast_rows`` of them."""
    return rows.join(F.broadcast(ids) if ids.count() <= broadcast_rows else ids, "row", how)


def of_both(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """The pairs (a, b) with the facts (row, x) of both as x_a and x_b, of rows in ``pairs`` alone."""
    wanted = staged(pairs.select(F.col("a").alias("row")).unionByName(pairs.select(F.col("b").alias("row"))).distinct())
    needed = among(facts, wanted, "left_semi")
    x = facts.columns[1]
    side = lambda end: needed.select(F.col("row").alias(end), F.col(x).alias(f"x_{end}"))
    return pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "x_a", "x_b")


def histograms(sets: DataFrame) -> DataFrame:
    """(row, bins): how many hashes of a set lie in each of 256 equal ranges, as 16-bit numbers."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            bins = [np.bincount(np.frombuffer(x, np.uint8)[7::8], minlength=256).astype(np.uint16).tobytes() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bins, pa.binary())], names=["row", "bins"])

    return sets.where(F.length("hashes") <= 8 * 65_535).select("row", "hashes").mapInArrow(count, "row long, bins binary").unionByName(
        sets.where(F.length("hashes") > 8 * 65_535).select("row", F.lit(b"").alias("bins"))
    )


def suffix_filtered(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs that may share enough: no more hashes than the smaller count in each of 256 ranges."""

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            may = []
            for left, right in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(left, np.uint16).astype(np.int64), np.frombuffer(right, np.uint16).astype(np.int64)
                # sets too large for the bins have none and go on
                may.append(not len(x) or not len(y) or (num + den) * np.minimum(x, y).sum() >= num * (x.sum() + y.sum()))
            yield batch.select(["a", "b"]).filter(pa.array(may, pa.bool_()))

    return of_both(pairs, histograms(sets)).mapInArrow(bound, "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sets satisfy den * intersection >= num * union; whole sets travel only for what passes the suffix filter."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            passed = []
            for left, right in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                joined = np.frombuffer(left + right, np.uint64).copy()
                joined.sort()
                shared = int((joined[1:] == joined[:-1]).sum())
                passed.append(den * shared >= num * (len(joined) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(passed, pa.bool_()))

    likely = staged(suffix_filtered(pairs, sets, num, den))
    return of_both(likely, sets.select("row", "hashes")).mapInArrow(check, "a long, b long")


def best_centre(found: DataFrame) -> DataFrame:
    """Of the centres that a row met, the one it met in most lists (then the least); its other pairs wait for a later round."""
    met = found.groupBy("row", "other").agg(F.count("*").alias("lists"))
    best = met.groupBy("other").agg(F.max_by("row", F.struct("lists", -F.col("row"))).alias("row"))
    return best.select(F.col("row").alias("a"), F.col("other").alias("b"))


def unsettled(postings: DataFrame, roots: DataFrame, main_rows: int) -> DataFrame:
    """The postings of lists with rows of several components, with comp and salt.

    Lists of one main component (that of their most central row) are met together, in parts. Rows of the main
    component are dealt to ``p`` groups and all others to ``q``, of about ``main_rows`` each. A part is one group of
    either kind, so that every row of the main component meets every other one, or two groups of others.
    """
    comp = F.coalesce(F.col("root"), F.col("row"))
    known = postings.join(roots.withColumnRenamed("node", "row"), "row", "left").withColumn("comp", comp).drop("root")
    lists = known.groupBy("token").agg(
        F.min("comp").alias("first"), F.max("comp").alias("last"), F.min_by("comp", F.struct(F.col("place").bitwiseAND((1 << 32) - 1), "place", "row")).alias("main")
    )
    known = staged(known.join(lists.where("first <> last").select("token", "main"), "token"))
    groups = lambda kind: F.greatest(F.ceil(F.count_if(kind) / main_rows), F.lit(1)).cast("int")
    sizes = known.groupBy("main").agg(groups(F.col("comp") == F.col("main")).alias("p"), groups(F.col("comp") != F.col("main")).alias("q"))
    p, q = F.col("p"), F.col("q")
    of = lambda n: F.pmod(F.xxhash64("row"), n).cast("int")
    every = lambda n: F.sequence(F.lit(0), n - 1)
    own = F.transform(every(q), lambda j: of(p) * q + j)
    mixed = F.transform(every(p), lambda i: i * q + of(q))
    alike = F.transform(every(q), lambda j: p * q + F.least(of(q), j) * q + F.greatest(of(q), j))
    salts = F.when(F.col("comp") == F.col("main"), own).otherwise(F.concat(mixed, alike))
    return known.join(sizes, "main").withColumn("salt", F.explode(salts)).drop("p", "q")


def components_of(sets: DataFrame, first: DataFrame, shingles: int, num: int = 4, den: int = 5, part_rows: int = PART_ROWS, main_rows: int = MAIN_ROWS) -> DataFrame:
    """(node, root) of the rows that are linked with others; ``first`` has the rows of ``sets`` with distinct sets that are not empty, of so many ``shingles``."""
    table = frequency_table(first, shingles)
    first = spread(prefix_postings(first, table, num, den, part_rows), table, part_rows)
    roots, dense = None, 0
    while True:
        found = staged(meet(first, num, den, dense))
        met = found.where("other is not null").select("row", "other")
        pairs = staged(best_centre(met) if dense == 0 else met.select(F.col("row").alias("a"), F.col("other").alias("b")).distinct())
        links = staged(verified(pairs, sets, num, den))
        if roots is None:
            roots = staged(components(links))
        elif links.limit(1).count():
            known = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
            roots = staged(components(known.unionByName(links)))
        if dense is None:
            return roots
        left = found.where("other is null").drop("other")
        # from the second round on a row may be in several parts of a list
        left = staged(unsettled(left if dense == 0 else left.distinct(), roots, main_rows))
        if left.limit(1).count() == 0:
            return roots
        first, dense = left, (DENSE_PAIRS if dense == 0 else None)


def marked_groups(docs: DataFrame, width: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """The rows of ``similar_groups`` with digest and stays: whether the row is the least (doc_id, digest) of its component.

    A null doc_id comes last. Rows of equal (doc_id, digest) stay or go together; rows without words all stay.
    """
    # sets may be long, so batches are bound by their bytes; postings are short
    with arrow_batches(docs.sparkSession, rows=50_000, size=4 << 20):
        return _marked_groups(docs, width, num, den)


def _marked_groups(docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    sets = staged(shingle_sets(docs, width))
    signature = ["sig_a", "sig_b", "n"]
    name = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "digest")
    classes = staged(sets.where("n > 0").groupBy(*signature).agg(F.min("row").alias("row"), F.min(name).alias("least"), F.count("*").alias("size")))
    repeated = classes.where("size > 1").select(*signature, F.col("row").alias("first"), "size")
    total = sets.count()
    rows = sets.select("row", "doc_id", "digest", *signature)
    copies = staged(
        join_by_group(rows.drop("digest").withColumn("sig", F.struct(*signature)).drop("sig_a", "sig_b"), repeated.select(F.struct(*signature).alias("sig"), "first", "size"), "sig", "size", total)
        .where("row <> first").select("row")
    )
    shingles = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    roots = components_of(sets, among(sets.where("n > 0"), copies, "left_anti"), shingles, num, den)
    class_root = classes.join(roots.withColumnRenamed("node", "row"), "row", "left").withColumn("root", F.coalesce("root", "row"))
    class_root = staged(class_root)
    keeper = class_root.groupBy("root").agg(F.min("least").alias("keeper"))
    named = staged(class_root.join(keeper, "root").select(F.struct(*signature).alias("sig"), "keeper", "size"))
    full = join_by_group(rows.where("n > 0").withColumn("sig", F.struct(*signature)), named, "sig", "size", total)
    full = full.withColumn("component_id", F.col("keeper.doc_id")).withColumn("stays", name.eqNullSafe(F.col("keeper")))
    empty = rows.where("n = 0").withColumn("component_id", F.col("doc_id")).withColumn("stays", F.lit(True))
    columns = ["row", "doc_id", "n", "component_id", "digest", "stays"]
    return full.select(*columns).unionByName(empty.select(*columns))


def similar_groups(docs: DataFrame, width: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """One row per document: row, doc_id, n (size of its set) and component_id, the least doc_id reached by links.

    Two documents link when den * intersection >= num * union of their sets. A document with fewer than
    ``width`` words is one shingle; without words it links with nothing and is its own component. A
    null text is empty. Documents of equal sets link; repeated rows do as well. A component whose ids are
    all null has a null id. Other columns are ignored; an empty table gives an empty result.
    """
    return marked_groups(docs, width, num, den).select("row", "doc_id", "n", "component_id")


def drop_similar(docs: DataFrame) -> DataFrame:
    """One document of each group of similar ones stays: the one with the least doc_id (null last), of equal ids that
    with the least digest of the text; all columns kept.

    doc_id names a row unless rows repeat; then equal (doc_id, text) rows of a group are made one. Documents
    without words are no group and all stay.
    """
    groups = staged(marked_groups(docs).select("doc_id", "n", "digest", "stays"))
    keys = ["doc_id", "digest"]
    by_key = groups.groupBy(*keys).agg(F.max("stays").alias("stays"), F.max("n").alias("n"), F.count("*").alias("rows"))
    dropped = staged(by_key.where(~F.col("stays")).select("doc_id", F.col("digest").alias("_digest")))
    keys = ["doc_id", "_digest"]
    marked = docs.withColumn("_digest", digest_of())
    kept = without(marked, dropped, keys)
    repeated = staged(by_key.where("stays and n > 0 and rows > 1").select("doc_id", F.col("digest").alias("_digest")))
    if repeated.limit(1).count():
        single = without(kept, repeated, keys)
        again = repeated.select(*[F.col(k).alias(f"_again_{k}") for k in keys])
        same = [kept[k].eqNullSafe(again[f"_again_{k}"]) for k in keys]
        kept = single.unionByName(kept.join(again, same, "left_semi").dropDuplicates(keys))
    return kept.drop("_digest")


def result(docs: DataFrame) -> DataFrame:
    return similar_groups(docs).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


RESULT_SQL = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS w FROM documents),
sets AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                        ELSE list_distinct([array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)]) END AS s FROM words),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
pairs AS (
    SELECT a.doc_id AS a, b.doc_id AS b FROM items a JOIN items b ON a.g = b.g AND a.doc_id <> b.doc_id
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach(doc_id, root) AS (
    SELECT doc_id, doc_id FROM sets UNION SELECT reach.doc_id, pairs.b FROM reach JOIN pairs ON reach.root = pairs.a)
SELECT doc_id, len(s) AS n_shingles, least(doc_id, min(root)) AS component_id
FROM sets LEFT JOIN reach USING (doc_id) GROUP BY doc_id, s
"""
