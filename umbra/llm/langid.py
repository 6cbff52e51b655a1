"""Language identification by words first, backing off to ever shorter character n-grams for unseen words."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbra.llm.common import Cache, arrow_batches, crc_bucket, join_by_group, staged, text_of, union_all
from umbra.llm.hashing import distinct_words, parts_of

#: Lengths of the n-grams, tried from the longest to the shortest.
GRAMS = (5, 4, 3, 2, 1)
#: So many of the most frequent words go to the tasks at most.
MOST_WORDS = 200_000


def bare(token: str) -> str:
    """The letters of a lower-cased token, without what stands around or between them."""
    return token if token.isalpha() else "".join(filter(str.isalpha, token))


def words_in(token: bytes) -> list[str]:
    """The words with letters of a token between ASCII white space, which may hold other white space."""
    return [word for word in map(bare, token.decode("utf-8", "replace").lower().split()) if word]


def grams_of(word: str, n: int) -> list[str]:
    marked = f"^{word}$" if n > 1 else word
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def grams(word: Column, n: int) -> Column:
    """The same in Spark."""
    marked = F.concat(F.lit("^"), word, F.lit("$")) if n > 1 else word
    places = F.when(F.length(marked) >= n, F.sequence(F.lit(1), F.length(marked) - n + 1))
    return F.transform(places, lambda i: F.substring(marked, i, F.lit(n)))


def word_counts(training: DataFrame, flush: int = 300_000) -> DataFrame:
    """(lang, word, count) of the training texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, defaultdict[bytes, int]] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for lang, tokens in seen.items():
                words: Counter[str] = Counter()
                for token, times in tokens.items():
                    for word in words_in(token):
                        words[word] += times
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(words), pa.string()), pa.array(words.keys(), pa.string()), pa.array(words.values(), pa.int64())],
                    names=["lang", "word", "count"],
                )
            seen.clear()

        for part in parts_of(batches, 1):
            langs = part.column(0).dictionary_encode()
            tokens, numbers, sizes = distinct_words(part.column(1))
            cells = np.repeat(langs.indices.to_numpy().astype(np.int64), sizes) * len(tokens) + numbers
            table = np.bincount(cells, minlength=len(langs.dictionary) * len(tokens)).reshape(len(langs.dictionary), -1)
            for lang, times in zip(langs.dictionary.to_pylist(), table, strict=True):
                there = np.flatnonzero(times)
                mine = seen.setdefault(lang, defaultdict(int))
                for i, n in zip(there.tolist(), times[there].tolist(), strict=True):
                    mine[tokens[i]] += n
            if sum(map(len, seen.values())) >= flush:
                yield from rows()
        yield from rows()

    counted = training.select("lang", "text").mapInArrow(count, "lang string, word string, count long")
    return counted.groupBy("lang", "word").agg(F.sum("count").alias("count"))


def gram_counts(words: DataFrame, n: int) -> DataFrame:
    """(lang, gram, count) of the n-grams of all words, made from the word counts."""
    spelled = words.select("lang", "count", F.explode(grams(F.col("word"), n)).alias("gram"))
    return spelled.groupBy("lang", "gram").agg(F.sum("count").alias("count"))


def lifts(counts: DataFrame, key: str, langs: list[str], floor: float) -> DataFrame:
    """(key, lift, times): by how much its log10 share of each language is above ``floor``, 0 where it has none, and its count in all."""
    totals = counts.groupBy("lang").agg(F.sum("count").alias("total"))
    shares = counts.join(F.broadcast(totals), "lang")  # a row per language
    lift = F.log10(F.col("count") / F.col("total")) - floor
    each = [F.coalesce(F.max(F.when(F.col("lang") == lang, lift)), F.lit(0.0)) for lang in langs]
    return shares.groupBy(key).agg(F.array(*each).alias("lift"), F.sum("count").alias("times"))


def least_times(words: DataFrame, most: int, levels: int = 8) -> int:
    """The least count such that no more than ``most`` words have it or more, as far as ``levels`` steps for each doubling tell."""
    level = F.floor(levels * F.log2("times")).cast("int")
    types = words.groupBy(level.alias("level")).agg(F.count("*").alias("types")).orderBy(F.desc("level")).collect()  # some hundred rows
    before, least = 0, None
    for row in types:
        before += row["types"]
        if before > most:
            break
        least = row["level"]
    return int(np.ceil(2 ** ((types[0]["level"] + 1 if least is None else least) / levels) - 1e-9)) if types else 1


def backed_off(words: DataFrame, counts: DataFrame, langs: list[str], floor: float) -> DataFrame:
    """(word, lift): means over the n-grams of the longest length that has known ones; no row when no length has."""
    out, left = [], words
    for n in GRAMS:
        spelled = staged(left.select("word", F.explode(grams(F.col("word"), n)).alias("gram")))
        sizes = staged(spelled.groupBy("gram").agg(F.count("*").alias("size")))
        wanted = gram_counts(counts, n)
        totals = wanted.groupBy("lang").agg(F.sum("count").alias("total"))  # over all n-grams, wanted or not
        shares = wanted.join(sizes.select("gram"), "gram", "left_semi").join(F.broadcast(totals), "lang")
        lift = F.log10(F.col("count") / F.col("total")) - floor
        each = [F.coalesce(F.max(F.when(F.col("lang") == lang, lift)), F.lit(0.0)) for lang in langs]
        known = staged(shares.groupBy("gram").agg(F.array(*each).alias("lift")).join(sizes, "gram"))
        hits = join_by_group(spelled, known, "gram", "size", spelled.count())
        mean = F.array(*[F.avg(F.get("lift", i)) for i in range(len(langs))])
        out.append(staged(hits.groupBy("word").agg(mean.alias("lift"))))
        left = staged(left.join(out[-1], "word", "left_anti"))
        if left.limit(1).count() == 0:
            break
    return union_all(out)


_SCORED = "row long, doc_id long, held_out boolean, letters long, total array<double>, words array<string>, times array<long>"


def identify(docs: DataFrame, folds: int = 4, held_out: int = 2, most_words: int = MOST_WORDS, floor: float = -7.0) -> DataFrame:
    """doc_id, held_out, lang_pred and score (0 to 1) of every document.

    Learns from text and lang of the documents whose crc32 of the id is not ``held_out`` mod ``folds``
    and whose lang is known; predictions see the text alone. The most frequent words, ``most_words`` at most,
    go to the tasks; all other words and the n-grams of unseen ones are looked up by joins, so every training
    word and n-gram counts and the result does not depend on that number. Null texts and texts without letters are
    ``und`` with score 0, as are all if nothing was learned. Ties go to the first language in order. Long texts
    are read whole, repeated rows learned from and judged each; an empty table gives no rows, and other columns are
    ignored.
    """
    with arrow_batches(docs.sparkSession, rows=10_000, size=8 << 20):
        return _identify(docs, folds, held_out, most_words, floor)


def _identify(docs: DataFrame, folds: int, held_out: int, most_words: int, floor: float) -> DataFrame:
    spark = docs.sparkSession
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
        (crc_bucket("doc_id", folds) == held_out).alias("held_out"), text_of().alias("text"), F.col("lang").cast("string").alias("lang"),
    )
    counts = staged(word_counts(rows.where("not held_out and lang is not null")))
    langs = sorted(r[0] for r in counts.select("lang").distinct().collect())
    words = staged(lifts(counts, "word", langs, floor)) if langs else counts.select("word", F.array().cast("array<double>").alias("lift"), F.col("count").alias("times"))
    least = least_times(words, most_words)
    frequent = words.where(F.col("times") >= least).select("word", "lift").toArrow()
    vectors = frequent.column("lift").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(langs)).astype(np.float32) if frequent.num_rows else np.empty((0, len(langs)), np.float32)
    shared = spark.sparkContext.broadcast((frequent.column("word").to_pylist(), vectors))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, vectors = shared.value
        at, size = {w: i for i, w in enumerate(names)}, len(langs) + 2

        def of(token: bytes) -> bytes:
            """As 32-bit numbers: sums of its frequent words, the number of its words, and of those that are not frequent."""
            out = np.zeros(size, np.float32)
            for word in words_in(token):
                i = at.get(word)
                out[-2] += 1
                if i is None:
                    out[-1] += 1
                else:
                    out[:-2] += vectors[i]
            return out.tobytes()

        cached = Cache(of, 50_000)
        for part in parts_of(batches, 3):
            tokens, numbers, sizes = distinct_words(part.column(3))
            table = np.frombuffer(b"".join([cached[t] for t in tokens]), np.float32).reshape(-1, size)
            sums = np.zeros((part.num_rows, size))
            some = np.flatnonzero(sizes)
            if len(some):
                sums[some] = np.add.reduceat(table[numbers].astype(np.float64), (np.cumsum(sizes) - sizes)[some], axis=0)
            others = np.flatnonzero(table[:, -1])
            rare_words = {i: [w for w in words_in(tokens[i]) if w not in at] for i in others.tolist()}
            is_rare = np.zeros(len(tokens), bool)
            is_rare[others] = True
            where = is_rare[numbers]
            cells, times = np.unique(np.repeat(np.arange(part.num_rows), sizes)[where] * max(len(tokens), 1) + numbers[where], return_counts=True)
            rare: list[Counter[str]] = [Counter() for _ in range(part.num_rows)]
            for cell, n in zip(cells.tolist(), times.tolist(), strict=True):
                row, token = divmod(cell, len(tokens))
                for word in rare_words[token]:
                    rare[row][word] += n
            yield pa.RecordBatch.from_arrays(
                [
                    *part.columns[:3], pa.array(sums[:, -2].astype(np.int64)), pa.array(list(sums[:, :-2]), pa.list_(pa.float64())),
                    pa.array([list(r) for r in rare], pa.list_(pa.string())), pa.array([list(r.values()) for r in rare], pa.list_(pa.int64())),
                ],
                names=[c.split()[0] for c in _SCORED.split(", ")],
            )

    scored = staged(rows.select("row", "doc_id", "held_out", "text").mapInArrow(score, _SCORED))
    rare = scored.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", "x.*").toDF("row", "word", "times")
    wanted = staged(rare.groupBy("word").agg(F.count("*").alias("size")))
    unseen = staged(wanted.join(words, "word", "left_anti").select("word"))
    found = words.where(F.col("times") < least).join(wanted, "word").select("word", "lift", "size")
    if langs and unseen.limit(1).count():
        found = found.unionByName(backed_off(unseen, counts, langs, floor).join(wanted, "word"))
    # a word that nothing is known of has the floor for all languages and needs no row
    hits = join_by_group(rare, staged(found), "word", "size", wanted.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0])
    sums = hits.groupBy("row").agg(*[F.sum(F.col("times") * F.get("lift", i)).alias(f"s{i}") for i in range(len(langs))], F.count("*").alias("hits"))
    joined = scored.drop("words", "times").join(sums, "row", "left")
    lift = F.array(*[F.coalesce(f"s{i}", F.lit(0.0)) for i in range(len(langs))]).cast("array<double>")
    return joined.select("doc_id", "held_out", "letters", "total", lift.alias("lift")).mapInArrow(chosen(langs), "doc_id long, held_out boolean, lang_pred string, score double")


def chosen(langs: list[str]):
    """The likeliest language and its probability, from the sums of the frequent words (``total``) and of all others."""

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            letters = batch.column(2).to_numpy()
            preds, odds = np.full(len(letters), "und", object), np.zeros(len(letters))
            if langs and len(letters):
                # without the floor of every word, which all languages share
                sums = sum(c.flatten().to_numpy().reshape(len(letters), -1) for c in batch.columns[3:5])
                # the posterior of a token of the text on average, sharpened by the root of their number
                scaled = sums / np.sqrt(np.maximum(letters, 1))[:, None] * np.log(10)
                shares = np.exp(scaled - scaled.max(axis=1, keepdims=True))
                best, there = shares.argmax(axis=1), letters > 0
                preds[there] = np.array(langs, object)[best[there]]
                odds[there] = (shares.max(axis=1) / shares.sum(axis=1))[there]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(preds, pa.string()), pa.array(odds)], names=["doc_id", "held_out", "lang_pred", "score"])

    return predict
