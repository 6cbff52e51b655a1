"""Information-theoretic sanitisation of personal data, in DataFrame operations only.

Patterns find the protected entities (addresses, card and phone numbers). Then the corpus tells which
other terms give an entity away: the pointwise mutual information of a term and an entity, as a share
of the entity's information content, is 1 for a term that occurs with it alone and 0 for one that is
independent of it. Terms beyond one threshold are generalised to their kind, beyond a second one removed,
wherever they stand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from umbra.llm.common import staged, text_of, union_all

#: Kinds and their patterns, in the order of the report. Possessive quantifiers and the look-behind keep
#: long texts linear; they match what the plain patterns match, leftmost and non-overlapping.
PATTERNS = (
    ("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    ("card", r"[0-9](?:[\x20-]?[0-9])++"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)
_OCTETS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?:\.(?!$)|$)){4}$"
WORD = r"[\p{L}\p{N}]{3,}"
_EDGE = r"[\p{L}\p{N}]"


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    back = F.reverse(digits)
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(digits)),
        F.lit(0),
        lambda sum_, i: sum_ + _luhn_digit(F.substring(back, i, F.lit(1)).cast("int"), i),
    )
    return total % 10 == 0


def _luhn_digit(digit: Column, place: Column) -> Column:
    doubled = digit * 2
    return F.when(place % 2 == 1, digit).when(doubled > 9, doubled - 9).otherwise(doubled)


def valid(kind: Column, hit: Column) -> Column:
    digits = F.regexp_replace(hit, "[^0-9]", "")
    long = F.length(digits)
    return (
        F.when(kind == "ip", hit.rlike(_OCTETS))
        .when(kind == "card", F.when(long.between(13, 19), luhn(digits)).otherwise(False))
        .when(kind == "phone", long.between(9, 15))
        .otherwise(True)
    )


def entity(kind: Column, hit: Column) -> Column:
    """The protected value behind a hit, however it is written."""
    digits = F.regexp_replace(hit, "[^0-9]", "")
    return F.concat_ws(":", kind, F.when(kind.isin("card", "phone"), digits).otherwise(F.lower(hit)))


def located(hits: DataFrame, context: int) -> DataFrame:
    """Every match of ``pattern`` in ``text``: row, kind, hit, start, end, and ``context`` characters on both sides.

    ``hits`` has row, text, kind, pattern and all matches in order; what lies between them gives their places.
    """
    pieces = hits.withColumn("pieces", F.split("text", F.col("pattern"), -1)).select(
        "row", "kind", "pieces", F.posexplode("hits").alias("pos", "hit")
    )
    before, after = F.get("pieces", F.col("pos")), F.get("pieces", F.col("pos") + 1)
    single = pieces.select(
        "row", "kind", "pos", "hit", F.length(before).alias("gap"), F.right(before, F.lit(context)).alias("before"), F.left(after, F.lit(context)).alias("after")
    )
    so_far = Window.partitionBy("row", "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.length("hit")).over(so_far).cast("long")
    return single.withColumn("end", end).withColumn("start", F.col("end") - F.length("hit"))


def base_hits(texts: DataFrame, context: int) -> DataFrame:
    """The valid matches of all patterns in ``texts`` (row, text)."""
    may = {"email": F.contains("text", F.lit("@")), "phone": F.contains("text", F.lit("+"))}
    found = [
        F.struct(
            F.lit(kind).alias("kind"),
            F.lit(pattern).alias("pattern"),
            F.when(may.get(kind, F.lit(True)), F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("hits"),
        )
        for kind, pattern in PATTERNS
    ]
    rows = texts.select("row", "text", F.explode(F.array(*found)).alias("found")).select("row", "text", "found.*")
    matched = located(rows.where(F.size("hits") > 0), context)
    return matched.where(valid(F.col("kind"), F.col("hit")))


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def context_terms(hits: DataFrame, context: int) -> DataFrame:
    """(entity, term, row, context): the whole words near each hit, and a hash of what surrounds it."""
    before = F.when(F.length("before") == context, F.regexp_replace("before", f"^{_EDGE}+", "")).otherwise(F.col("before"))
    after = F.when(F.length("after") == context, F.regexp_replace("after", f"{_EDGE}+$", "")).otherwise(F.col("after"))
    near = F.concat_ws("\n", before, after)
    return hits.select(
        entity(F.col("kind"), F.col("hit")).alias("entity"), "row", F.xxhash64(near).alias("context"),
        F.explode(F.array_distinct(words(near))).alias("term"),
    )


def document_frequency(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, documents) of the distinct ``terms`` over all whole texts, counted before they are joined: a semi join would be moved below the counting."""
    seen = texts.select(F.explode(F.array_distinct(words(F.col("text")))).alias("term"))
    return seen.groupBy("term").agg(F.count("*").alias("documents")).join(terms, "term")


def risky_terms(texts: DataFrame, hits: DataFrame, generalise: float, remove: float, least_contexts: int, context: int) -> DataFrame:
    """(term, disclosure, action): terms whose largest disclosure of an entity reaches ``generalise``.

    A pair counts when it was seen in ``least_contexts`` different surroundings, so copies of a document
    prove nothing. Frequencies are in documents, over the whole corpus.
    """
    total = texts.count()
    near = staged(context_terms(hits, context).distinct())
    pairs = near.groupBy("entity", "term").agg(F.count_distinct("row").alias("both"), F.count_distinct("context").alias("contexts"))
    pairs = staged(pairs.where(F.col("contexts") >= least_contexts))
    entities = hits.select(entity(F.col("kind"), F.col("hit")).alias("entity"), "row").distinct().groupBy("entity").agg(F.count("*").alias("holders"))
    frequency = document_frequency(texts, staged(pairs.select("term").distinct()))
    information = F.log2(F.lit(float(max(total, 1))) / F.col("holders"))
    mutual = F.log2(F.col("both") * F.lit(float(max(total, 1))) / (F.col("holders") * F.col("documents")))
    rated = pairs.join(entities, "entity").join(frequency, "term").withColumn("disclosure", F.round(F.try_divide(mutual, information), 9))
    worst = rated.groupBy("term").agg(F.max("disclosure").alias("disclosure")).where(F.col("disclosure") >= generalise)
    return worst.withColumn("action", F.when(F.col("disclosure") >= remove, "remove").otherwise("generalise"))


def term_hits(texts: DataFrame, terms: DataFrame, broadcast_rows: int) -> DataFrame:
    """(row, hit, start, end, action) of all risky terms in all texts."""
    few = terms.count() <= broadcast_rows
    here = texts.select("row", F.explode(F.array_distinct(words(F.col("text")))).alias("term"))
    met = staged(here.join(F.broadcast(terms) if few else terms, "term").groupBy("row").agg(F.collect_set("term").alias("terms")))
    matched = texts.join(met.hint("merge"), "row")  # grows with the corpus, so it is shuffled at every size
    pattern = F.concat(F.lit(f"(?iu)(?<!{_EDGE})(?:"), F.array_join(F.array_sort("terms"), "|"), F.lit(f")(?!{_EDGE})"))
    patterned = matched.select("row", "text", F.lit("term").alias("kind"), pattern.alias("pattern"))
    hits = located(patterned.withColumn("hits", F.regexp_extract_all("text", F.col("pattern"), F.lit(0))), 0)
    hits = hits.withColumn("term", F.lower("hit"))
    return hits.join(F.broadcast(terms) if few else terms, "term").select("row", "kind", "hit", "start", "end", "action")


def found(
    docs: DataFrame,
    generalise: float = 0.6,
    remove: float = 0.8,
    least_contexts: int = 3,
    context: int = 120,
    broadcast_rows: int = 200_000,
    with_text: bool = False,
) -> DataFrame:
    """doc_id, base and terms (arrays of spans, by kind and start) of every document; with its text if asked.

    A span is (place of the kind, kind, start, end, action), in code points, end exclusive. Base spans
    have the action ``mask``; terms that touch a base span are left to it. Null texts are empty and have no spans;
    repeated rows are documents of their own. Other columns are ignored and an empty table gives no rows.
    """
    texts = staged(docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")))
    hits = staged(base_hits(texts, context))
    terms = staged(risky_terms(texts, hits, generalise, remove, least_contexts, context))
    kinds = F.create_map(*[F.lit(x) for i, (kind, _) in enumerate(PATTERNS) for x in (kind, i)])
    as_span = lambda place, action: F.struct(place.alias("place"), "kind", "start", "end", action.alias("action"))
    spans = union_all(
        [
            hits.select("row", as_span(F.element_at(kinds, F.col("kind")), F.lit("mask")).alias("span")),
            term_hits(texts, terms, broadcast_rows).select("row", as_span(F.lit(len(PATTERNS)), F.col("action")).alias("span")),
        ]
    )
    by_row = spans.groupBy("row").agg(F.array_sort(F.collect_list("span")).alias("spans"))
    rows = (texts if with_text else texts.drop("text")).join(by_row, "row", "left")
    none = F.array().cast("array<struct<place:int,kind:string,start:bigint,end:bigint,action:string>>")
    rows = rows.withColumn("spans", F.coalesce("spans", none))
    base = F.filter("spans", lambda s: s["place"] < len(PATTERNS))
    rows = rows.withColumn("base", base)
    free = F.filter(
        "spans",
        lambda s: (s["place"] == len(PATTERNS)) & ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])),
    )
    return rows.withColumn("terms", free).drop("spans", "row")


def sanitised(docs: DataFrame, **options) -> DataFrame:
    """doc_id and the text with base spans masked by their kind, risky terms generalised to NUMBER, CODE or WORD, or removed.

    Of overlapping spans the one that starts first stays, then the first kind.
    """
    rows = found(docs, with_text=True, **options)
    ordered = F.array_sort(F.transform(F.concat("base", "terms"), lambda s: F.struct(s["start"].alias("start"), s["place"].alias("place"), s["end"].alias("end"), s["kind"].alias("kind"), s["action"].alias("action"))))
    kept = F.aggregate(
        ordered, F.slice(ordered, 1, 0), lambda kept, s: F.when(s["start"] >= F.coalesce(F.get(kept, F.size(kept) - 1)["end"], F.lit(0)), F.concat(kept, F.array(s))).otherwise(kept)
    )
    rows = rows.withColumn("kept", kept)
    start_of = lambda i: F.coalesce(F.get("kept", i - 1)["end"], F.lit(0)).cast("int")

    def written(span: Column, i: Column) -> Column:
        gap = F.substring(F.col("text"), start_of(i) + 1, span["start"].cast("int") - start_of(i))
        hit = F.substring(F.col("text"), span["start"].cast("int") + 1, (span["end"] - span["start"]).cast("int"))
        kind = F.when(hit.rlike("^[0-9]+$"), "[NUMBER]").when(hit.rlike("[0-9]"), "[CODE]").otherwise("[WORD]")
        instead = F.when(span["action"] == "mask", F.concat(F.lit("["), F.upper(span["kind"]), F.lit("]"))).when(span["action"] == "remove", "").otherwise(kind)
        return F.concat(gap, instead)

    tail = F.substring(F.col("text"), start_of(F.size("kept")) + 1, F.length("text"))
    return rows.select("doc_id", F.concat(F.array_join(F.transform("kept", written), ""), tail).alias("text"))


def result(docs: DataFrame) -> DataFrame:
    rows = found(docs)
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return rows.select(
        "doc_id", *[count(kind) for kind, _ in PATTERNS],
        F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.concat("base", "terms")).alias("spans"),
    )


RESULT_SQL = r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
kinds(place, kind, pattern) AS (VALUES
    (0, 'email', '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+'), (1, 'ip', '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+'),
    (2, 'card', '[0-9](?:[\x20-]?[0-9])+'), (3, 'phone', '\+[0-9][\x20().0-9-]+[0-9]')),
matched AS (
    SELECT doc_id, place, kind, h.pos, h.hit, h.before, h.after FROM (
        SELECT doc_id, place, kind, unnest(list_transform(range(1, len(hits) + 1), lambda i: {'pos': i, 'hit': hits[i], 'before': pieces[i], 'after': pieces[i + 1]})) AS h
        FROM (SELECT doc_id, 0 AS place, 'email' AS kind, regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+') AS hits, string_split_regex(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+') AS pieces FROM docs
              UNION ALL SELECT doc_id, 1, 'ip', regexp_extract_all(text, '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+'), string_split_regex(text, '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+') FROM docs
              UNION ALL SELECT doc_id, 2, 'card', regexp_extract_all(text, '[0-9](?:[\x20-]?[0-9])+'), string_split_regex(text, '[0-9](?:[\x20-]?[0-9])+') FROM docs
              UNION ALL SELECT doc_id, 3, 'phone', regexp_extract_all(text, '\+[0-9][\x20().0-9-]+[0-9]'), string_split_regex(text, '\+[0-9][\x20().0-9-]+[0-9]') FROM docs))),
placed AS (
    SELECT *, regexp_replace(hit, '[^0-9]', '', 'g') AS digits,
           sum(length(before) + length(hit)) OVER (PARTITION BY doc_id, place ORDER BY pos) AS stop FROM matched),
hits AS (
    SELECT *, stop - length(hit) AS start, kind || ':' || CASE WHEN place >= 2 THEN digits ELSE lower(hit) END AS entity FROM placed
    WHERE CASE kind WHEN 'ip' THEN list_bool_and(list_transform(string_split(hit, '.'), lambda x: length(ltrim(x, '0')) <= 3 AND coalesce(try_cast(ltrim(x, '0') AS INTEGER), 0) <= 255))
               WHEN 'card' THEN length(digits) BETWEEN 13 AND 19 AND
                    list_sum(list_transform(range(1, length(digits) + 1), lambda i:
                        CASE WHEN i % 2 = 1 THEN digits[-i]::INTEGER WHEN digits[-i]::INTEGER > 4 THEN 2 * digits[-i]::INTEGER - 9 ELSE 2 * digits[-i]::INTEGER END)) % 10 = 0
               WHEN 'phone' THEN length(digits) BETWEEN 9 AND 15 ELSE true END),
surrounded AS (
    SELECT entity, doc_id, CASE WHEN length(before) >= 120 THEN regexp_replace(right(before, 120), '^[\p{L}\p{N}]+', '') ELSE before END || chr(10) ||
           CASE WHEN length(after) >= 120 THEN regexp_replace(left(after, 120), '[\p{L}\p{N}]+$', '') ELSE after END AS near FROM hits),
near AS (SELECT DISTINCT entity, doc_id, near, unnest(list_distinct(regexp_extract_all(lower(near), '[\p{L}\p{N}]{3,}'))) AS term FROM surrounded),
pairs AS (SELECT entity, term, count(DISTINCT doc_id) AS both_ FROM near GROUP BY ALL HAVING count(DISTINCT near) >= 3),
entities AS (SELECT entity, count(DISTINCT doc_id) AS holders FROM hits GROUP BY entity),
seen AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]{3,}'))) AS term FROM docs),
frequency AS (SELECT term, count(*) AS documents FROM seen WHERE term IN (SELECT term FROM pairs) GROUP BY term),
risky AS (
    SELECT term FROM (
        SELECT term, round(log2(both_ * n / (holders * documents)) / nullif(log2(n / holders), 0), 9) AS disclosure
        FROM pairs JOIN entities USING (entity) JOIN frequency USING (term) CROSS JOIN (SELECT count(*)::DOUBLE AS n FROM docs))
    GROUP BY term HAVING max(disclosure) >= 0.6),
affected AS (SELECT DISTINCT doc_id FROM seen JOIN risky USING (term)),
tokens AS (
    SELECT doc_id, unnest(list_transform(range(1, len(p) + 1), lambda i: {'pos': i, 'piece': p[i]})) AS t
    FROM (SELECT doc_id, regexp_extract_all(text, '[^\p{L}\p{N}]*[\p{L}\p{N}]+') AS p FROM docs JOIN affected USING (doc_id))),
words AS (
    SELECT doc_id, regexp_extract(t.piece, '[\p{L}\p{N}]+$') AS word, sum(length(t.piece)) OVER (PARTITION BY doc_id ORDER BY t.pos) AS stop FROM tokens),
terms AS (
    SELECT doc_id, stop - length(word) AS start, stop FROM words JOIN risky ON term = lower(word)
    WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.doc_id = words.doc_id AND h.start < words.stop AND words.stop - length(word) < h.stop)),
base AS (
    SELECT doc_id, count(*) FILTER (place = 0) AS n_email, count(*) FILTER (place = 1) AS n_ip, count(*) FILTER (place = 2) AS n_card, count(*) FILTER (place = 3) AS n_phone,
           string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY place, start) AS spans FROM hits GROUP BY doc_id),
more AS (SELECT doc_id, string_agg('term:' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start) AS spans FROM terms GROUP BY doc_id)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
       sha256(coalesce(base.spans, '')) AS base_sha256, concat_ws(',', base.spans, more.spans) AS spans
FROM docs LEFT JOIN base USING (doc_id) LEFT JOIN more USING (doc_id)
"""
