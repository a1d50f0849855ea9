"""The registered queries over the search operators, and their SQL.

Texts are whole tables (documents, benchmark items, part names, conversations, events by
user); pattern sets are taken from whole tables as well: benchmark items, and their words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiloom.functions.alignment import edit_alignment, edit_window
from lexiloom.functions.generate import sample_patterns
from lexiloom.functions.strings import common_prefix, edit_bounded, hamming_bounded, lex_less, normalised_bases, reverse_complement
from lexiloom.operators import approximate, compressed, exact, intervals, rank_select, suffix
from lexiloom.operators.windows import symbols
from lexiloom.plans import schemes
from lexiloom.sinks import records
from lexiloom.sources import scratch, sequences, tables
from lexiloom.streaming.search import search_stream

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


# ---- texts and patterns


def documents(spark: SparkSession, d: str) -> DataFrame:
    return tables.texts(tables.read(spark, d, "documents"), "doc_id")


def items(spark: SparkSession, d: str) -> DataFrame:
    return tables.texts(tables.read(spark, d, "benchmark"), "item_id")


def parts(spark: SparkSession, d: str) -> DataFrame:
    return tables.texts(tables.read(spark, d, "part"), "p_partkey", "p_name")


def turns(spark: SparkSession, d: str) -> DataFrame:
    rows = tables.read(spark, d, "conversations")
    return rows.select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def item_patterns(spark: SparkSession, d: str) -> DataFrame:
    return items(spark, d).toDF("pat_id", "pattern")


def numbered(words: DataFrame) -> DataFrame:
    """(pat_id, pattern) of distinct patterns, numbered in their order: a row for each of a pattern table."""
    rank = F.row_number().over(Window.orderBy("pattern")).cast("long")
    return words.distinct().select(rank.alias("pat_id"), "pattern")


def word_patterns(spark: SparkSession, d: str) -> DataFrame:
    words = F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{6,}"), 0))
    return numbered(items(spark, d).select(words.alias("pattern")))


def changed_words(spark: SparkSession, d: str) -> DataFrame:
    """The words with their middle symbol replaced by an underscore."""
    middle = F.expr("overlay(pattern placing '_' from int((char_length(pattern) + 1) / 2) for 1)")
    return word_patterns(spark, d).select("pat_id", middle.alias("pattern"))


def changed_names(spark: SparkSession, d: str) -> DataFrame:
    """The words of part names with an x put after their second symbol."""
    words = parts(spark, d).select(F.explode(F.regexp_extract_all("text", F.lit("[a-z]{4,}"), 0)).alias("pattern"))
    return numbered(words.select(F.expr("substring(pattern, 1, 2) || 'x' || substring(pattern, 3)").alias("pattern")))


def bases(texts: DataFrame) -> DataFrame:
    """Texts with nothing but their letters A, C, G, T left, raised."""
    kept = F.regexp_replace(F.translate("text", "acgt", "ACGT"), "[^ACGT]+", "")
    return texts.select("doc_id", kept.alias("text"))


def base_patterns(spark: SparkSession, d: str) -> DataFrame:
    """All distinct runs of 12 bases of the benchmark items."""
    from lexiloom.operators.windows import windows

    return numbered(windows(bases(items(spark, d)), 12).select(F.col("window").alias("pattern")))


def array_table(spark: SparkSession, d: str, suffixes: bool = False) -> DataFrame:
    return suffix.suffix_array(items(spark, d), keep_suffix=suffixes)


def full_table(spark: SparkSession, d: str) -> DataFrame:
    return suffix.columns(array_table(spark, d))


# ---- SQL pieces

SQL_WORDS = "words AS (SELECT row_number() OVER (ORDER BY pattern) AS pat_id, pattern FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]{6,}')) AS pattern FROM benchmark))"
SQL_CHANGED = "changed AS (SELECT pat_id, substring(pattern, 1, (length(pattern) + 1) // 2 - 1) || '_' || substring(pattern, (length(pattern) + 1) // 2 + 1) AS pattern FROM words)"
SQL_NAMES = "names AS (SELECT row_number() OVER (ORDER BY pattern) AS pat_id, pattern FROM (SELECT DISTINCT substring(w, 1, 2) || 'x' || substring(w, 3) AS pattern FROM (SELECT unnest(regexp_extract_all(p_name, '[a-z]{4,}')) AS w FROM part)))"


def sql_windows(texts: str, q: int, longest: str = "", name: str = "win") -> str:
    """CTEs for (doc_id, pos, w, t) of every window of q characters with the text from its start,
    as long as the longest of a table's patterns (``longest`` names the table and its column)."""
    tail = f"(SELECT greatest(coalesce(max(length({longest.split('.')[1]})), 0), {q}) FROM {longest.split('.')[0]})::INTEGER" if longest else str(q)
    return f"""{name}_c AS (
    SELECT doc_id, c * 512 AS base, substring(text, c * 512 + 1, 511 + {tail}) AS part
    FROM (SELECT doc_id, text, unnest(range(0, (greatest(length(text), 1) - 1) // 512 + 1)) AS c FROM {texts})
), {name} AS (
    SELECT doc_id, base + i - 1 AS pos, substring(part, i, {q}) AS w, substring(part, i, {tail}) AS t
    FROM (SELECT doc_id, base, part, unnest(range(1, least(512, length(part) - {q} + 1) + 1)) AS i FROM {name}_c)
)"""


SQL_DOCS = "docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)"
SQL_ITEMS = "items AS (SELECT item_id AS doc_id, coalesce(text, '') AS text FROM benchmark)"
SQL_BASES = """based AS (SELECT doc_id, regexp_replace(translate(coalesce(text, ''), 'acgt', 'ACGT'), '[^ACGT]', '', 'g') AS text FROM documents),
basep_items AS (SELECT item_id AS doc_id, regexp_replace(translate(coalesce(text, ''), 'acgt', 'ACGT'), '[^ACGT]', '', 'g') AS text FROM benchmark)"""
SQL_SA = (
    SQL_ITEMS
    + """, sa AS (
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY suffix) - 1 AS i, sa, suffix, CASE WHEN sa = 0 THEN '' ELSE substring(text, sa, 1) END AS bwt, text
    FROM (SELECT doc_id, text, sa, substring(text, sa + 1) AS suffix FROM (SELECT doc_id, text, unnest(range(0, length(text) + 1)) AS sa FROM items))
), full_t AS (
    SELECT *, sum(head) OVER (PARTITION BY doc_id ORDER BY i)::BIGINT AS run FROM (
        SELECT *, CASE WHEN bwt <> lag(bwt) OVER (PARTITION BY doc_id ORDER BY i) THEN 1 ELSE 0 END AS head,
               row_number() OVER (PARTITION BY doc_id ORDER BY bwt, i) - 1 AS lf,
               coalesce(lead(sa) OVER (PARTITION BY doc_id ORDER BY i), first_value(sa) OVER (PARTITION BY doc_id ORDER BY i)) AS phi_inv,
               coalesce(lag(sa) OVER (PARTITION BY doc_id ORDER BY i), last_value(sa) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS phi,
               sa - coalesce(lag(sa) OVER (PARTITION BY doc_id ORDER BY i), 0) AS dsa
        FROM sa)
)"""
)


# ---- sources


@query(
    f"""WITH {SQL_ITEMS}, t AS (
    SELECT doc_id, regexp_replace(translate(replace(text, chr(10), ''), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), '[^ACGT]', 'N', 'g') AS text FROM items
), o AS (SELECT *, format('{{:09d}}', doc_id) AS file FROM t)
SELECT row_number() OVER (ORDER BY file) - 1 AS seq_id, 'item' || doc_id AS name,
       (coalesce(sum(length(text) + 1) OVER (ORDER BY file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1)::BIGINT AS start,
       length(text)::BIGINT AS length, text FROM o"""
)
def s5_fasta(spark, d):
    """Benchmark items written as FASTA files, parsed into sequences."""
    body = F.concat(F.lit("skipped\n>item"), F.col("doc_id").cast("string"), F.lit(" of benchmark\n"), F.col("text"))
    return sequences.fasta_records(items(spark, d).select(F.format_string("%09d", "doc_id").alias("file"), body.alias("value")))


@query("SELECT item_id AS pat_id, 'read' || item_id AS name, replace(text, chr(10), ' ') AS pattern, repeat('I', length(text)::BIGINT) AS quality FROM benchmark")
def s6_fastq(spark, d):
    """Benchmark items written as FASTQ records, read again."""
    line = F.translate("text", "\n", " ")
    record = F.concat(F.lit("@read"), F.col("doc_id").cast("string"), F.lit(" x\r\n"), line, F.lit("\r\n+\r\n"), F.repeat(F.lit("I"), F.char_length("text")), F.lit("\r\n"))
    return sequences.fastq_records(items(spark, d).select(F.format_string("%09d", "doc_id").alias("file"), record.alias("value")))


SQL_EVENTS = """a AS (SELECT event_type, dense_rank() OVER (ORDER BY event_type) AS r FROM (SELECT DISTINCT event_type FROM events)),
seq AS (SELECT user_id, event_id, ts, r, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events JOIN a USING (event_type)),
pats AS (SELECT (x.r - 1) * (SELECT count(*) FROM a) + y.r - 1 AS pat_id, x.r AS p, y.r AS q FROM a x, a y)"""


def user_sequences(spark, d):
    return tables.sequences(tables.read(spark, d, "events"), "user_id", "event_type", ["ts", "event_id"])


def type_pairs(spark, d):
    """(pat_id, pattern) of all ordered pairs of event types, a handful."""
    n = tables.alphabet(tables.read(spark, d, "events"), "event_type").count()
    return spark.createDataFrame([(x * n + y, [x + 1, y + 1]) for x in range(n) for y in range(n)], "pat_id long, pattern array<int>")


@query(f"""WITH {SQL_EVENTS}, l AS (SELECT user_id, pos, r, lead(r) OVER (PARTITION BY user_id ORDER BY pos) AS s FROM seq)
SELECT user_id AS doc_id, pat_id, pos FROM l JOIN pats ON r = p AND s = q""")
def s4_int_pattern(spark, d):
    """Pairs of event types located in every user's events."""
    return exact.locate_symbols(user_sequences(spark, d), type_pairs(spark, d))


@query("SELECT event_type, dense_rank() OVER (ORDER BY event_type)::INTEGER AS rank FROM (SELECT DISTINCT event_type FROM events)")
def f14_alphabet(spark, d):
    return tables.alphabet(tables.read(spark, d, "events"), "event_type")


# ---- exact search

SQL_WORD_HITS = f"WITH {SQL_DOCS}, {SQL_WORDS}, {sql_windows('docs', 6, 'words.pattern')}, hits AS (SELECT doc_id, pat_id, pos, pattern FROM win JOIN words ON w = left(pattern, 6) AND starts_with(t, pattern))"


@query(SQL_WORD_HITS + " SELECT pat_id, coalesce(n, 0) AS n FROM words LEFT JOIN (SELECT pat_id, count(*) AS n FROM hits GROUP BY pat_id) USING (pat_id)")
def e1_count(spark, d):
    """Benchmark words counted in all documents."""
    return exact.count(documents(spark, d), word_patterns(spark, d))


@query(f"WITH {SQL_DOCS}, {SQL_ITEMS}, {sql_windows('docs', 12, 'items.text')} SELECT win.doc_id, items.doc_id AS pat_id, pos FROM win JOIN items ON w = left(items.text, 12) AND starts_with(t, items.text)")
def e2_locate(spark, d):
    """Whole benchmark items located in all documents."""
    return exact.locate(documents(spark, d), item_patterns(spark, d))


@query(f"WITH {SQL_DOCS}, {SQL_WORDS} SELECT doc_id, pat_id, strpos(text, pattern) - 1 AS pos FROM docs JOIN words ON contains(text, pattern)")
def e3_first_occ(spark, d):
    return exact.first_occurrence(documents(spark, d), word_patterns(spark, d))


@query(
    f"""WITH {SQL_ITEMS}, {SQL_WORDS}, p AS (SELECT pat_id, 'Q' || pattern || '.' AS pattern FROM words),
s AS (SELECT pat_id, l, right(pattern, l) AS x FROM (SELECT pat_id, pattern, unnest(range(1, length(pattern) + 1)) AS l FROM p)),
f AS (SELECT pat_id, max(l) AS l FROM s WHERE EXISTS (SELECT 1 FROM items WHERE contains(text, x)) GROUP BY pat_id)
SELECT pat_id, coalesce(f.l, 0)::INTEGER AS length FROM p LEFT JOIN f USING (pat_id)"""
)
def e5_longest_suffix(spark, d):
    """The longest suffix of each word, with a letter before and a stop behind it, in the items."""
    asked = word_patterns(spark, d).select("pat_id", F.concat(F.lit("Q"), "pattern", F.lit(".")).alias("pattern"))
    return exact.longest_suffix(items(spark, d), asked)


@query(f"WITH {SQL_SA}, {SQL_WORDS} SELECT doc_id, pat_id, min(i) AS b, max(i) AS e FROM sa JOIN words ON starts_with(suffix, pattern) GROUP BY ALL")
def e6_sa_interval(spark, d):
    return suffix.intervals(array_table(spark, d, True), word_patterns(spark, d))


@query(
    f"""WITH {SQL_SA}, {SQL_WORDS}, t AS (SELECT pat_id, substring(pattern, 2) AS pattern FROM words), v AS (
    SELECT doc_id, pat_id, min(i) AS b, max(i) AS e FROM sa JOIN t ON starts_with(suffix, pattern) GROUP BY ALL)
SELECT v.doc_id, v.pat_id, min(lf) AS b, max(lf) AS e FROM v JOIN words USING (pat_id) JOIN full_t f ON f.doc_id = v.doc_id AND f.i BETWEEN v.b AND v.e AND f.bwt = left(words.pattern, 1) GROUP BY ALL"""
)
def e8_backward_step(spark, d):
    """The words' last symbols as intervals, their first symbol put before by one step."""
    words = word_patterns(spark, d)
    tails = suffix.intervals(array_table(spark, d, True), words.select("pat_id", F.expr("substring(pattern, 2)").alias("pattern")))
    asked = tails.join(words.select("pat_id", F.expr("left(pattern, 1)").alias("symbol")), "pat_id")
    return suffix.backward_step(asked, full_table(spark, d), F.col("symbol"))


@query(
    f"""WITH {SQL_DOCS}, {SQL_WORDS}, {sql_windows('docs', 6, 'words.pattern')}, hits AS (
    SELECT doc_id, pat_id, pos, length(pattern) AS m FROM win JOIN words ON w = left(pattern, 6) AND starts_with(t, pattern))
SELECT doc_id, pat_id, pos - 1 AS pos, m + 1 AS m FROM hits JOIN docs USING (doc_id) WHERE pos > 0 AND substring(text, pos, 1) = ' '"""
)
def e9_extend_left(spark, d):
    """Occurrences of words extended to the left by a blank."""
    docs, words = documents(spark, d), word_patterns(spark, d)
    found = exact.locate(docs, words).join(words.select("pat_id", F.char_length("pattern").alias("m")), "pat_id")
    return exact.prepend(found, docs, F.lit(" ")).withColumn("m", F.col("m").cast("long"))


SQL_EXT = SQL_WORD_HITS + " SELECT pat_id, symbol, count(*) AS n FROM (SELECT pat_id, substring(text, @at, 1) AS symbol FROM hits JOIN docs USING (doc_id) WHERE @where) WHERE symbol <> '' GROUP BY ALL"


@query(SQL_EXT.replace("@at", "pos + length(pattern) + 1").replace("@where", "true"))
def e10_right_ext(spark, d):
    return exact.extensions(documents(spark, d), word_patterns(spark, d), "right")


@query(SQL_EXT.replace("@at", "pos").replace("@where", "pos > 0"))
def e10_left_ext(spark, d):
    return exact.extensions(documents(spark, d), word_patterns(spark, d), "left")


@query(
    f"""WITH {SQL_SA.replace("coalesce(text, '') AS text FROM benchmark", "reverse(coalesce(text, '')) AS text FROM benchmark")}, {SQL_WORDS}
SELECT doc_id, pat_id, min(i) AS b, max(i) AS e FROM sa JOIN words ON starts_with(suffix, reverse(pattern)) GROUP BY ALL"""
)
def e11_backward_interval(spark, d):
    """Intervals of the reversed words in the arrays of the reversed items."""
    turned = items(spark, d).select("doc_id", F.reverse("text").alias("text"))
    words = word_patterns(spark, d).select("pat_id", F.reverse("pattern").alias("pattern"))
    return suffix.intervals(suffix.suffix_array(turned, True), words)


@query(
    f"""WITH {SQL_SA}, {SQL_WORDS}, v AS (SELECT doc_id, pat_id, min(i) AS b, max(i) AS e FROM sa JOIN words ON starts_with(suffix, pattern) GROUP BY ALL)
SELECT v.doc_id, pat_id, b, e, sa.sa AS occ FROM v JOIN sa ON sa.doc_id = v.doc_id AND sa.i = v.e"""
)
def e15_interval_and_occ(spark, d):
    """Intervals with the suffix at their end as a sample."""
    table = array_table(spark, d, True)
    found = suffix.intervals(table, word_patterns(spark, d))
    ends = table.select("doc_id", F.col("i").alias("e"), F.col("sa").alias("occ"))
    return found.join(ends, ["doc_id", "e"]).select("doc_id", "pat_id", "b", "e", "occ")


SQL_STRANDS = f"""WITH {SQL_BASES}, {sql_windows('basep_items', 12, '', 'bw')}, bp AS (
    SELECT row_number() OVER (ORDER BY w) AS pat_id, w AS pattern FROM (SELECT DISTINCT w FROM bw)
), turned AS (
    SELECT pat_id, pattern, '+' AS strand FROM bp UNION ALL SELECT pat_id, translate(reverse(pattern), 'ACGT', 'TGCA'), '-' FROM bp
), {sql_windows('based', 12)}, found AS (SELECT doc_id, pat_id, strand, pos FROM win JOIN turned ON w = pattern)"""


def strands(spark, d):
    return exact.both_strands(bases(documents(spark, d)), base_patterns(spark, d))


@query(SQL_STRANDS + " SELECT * FROM found")
def e20_both_strands(spark, d):
    return strands(spark, d)


@query(f"WITH {SQL_DOCS}, {SQL_ITEMS}, {sql_windows('docs', 12, 'items.text')}, hits AS (SELECT win.doc_id, items.doc_id AS pat_id, pos FROM win JOIN items ON w = left(items.text, 12) AND starts_with(t, items.text)) SELECT doc_id, pat_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY pat_id ORDER BY doc_id, pos) AS k FROM hits) WHERE k <= 2")
def o3_first_two(spark, d):
    """The first two occurrences of each item: a limit on what is printed."""
    return exact.paged(exact.locate(documents(spark, d), item_patterns(spark, d)), 2)


@query(f"WITH {SQL_DOCS}, {SQL_ITEMS}, {sql_windows('docs', 12, 'items.text')} SELECT win.doc_id, items.doc_id AS pat_id, pos FROM win JOIN items ON w = left(items.text, 12) AND starts_with(t, items.text)")
def stream_locate(spark, d):
    """Items as a stream of patterns against the static documents, run to its end."""
    schema = tables.read(spark, d, "benchmark").schema
    stream = spark.readStream.schema(schema).parquet(f"{d}/benchmark.parque[t]").select(F.col("item_id").alias("pat_id"), F.col("text").alias("pattern"))
    out = scratch.folder(spark)
    found = search_stream(documents(spark, d), stream, (1, 12))
    found.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-offsets").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(found.schema).parquet(out)


# ---- approximate search

SQL_HAMMING = f"""WITH {SQL_ITEMS}, {SQL_WORDS}, {SQL_CHANGED}, lens AS (SELECT DISTINCT length(pattern) AS m FROM changed), places AS (
    SELECT doc_id, text, unnest(range(0, length(text))) AS pos FROM items
), w AS (
    SELECT doc_id, pos, m, regexp_replace(substring(text, pos + 1, m), '[^\\x00-\\x7F]', chr(1), 'g') AS w FROM places JOIN lens ON pos + m <= length(text)
), found AS (
    SELECT doc_id, pat_id, pos, m::INTEGER AS len, hamming(w, pattern)::INTEGER AS err FROM w JOIN changed ON length(pattern) = m WHERE hamming(w, pattern) <= 2
)"""


@query(SQL_HAMMING + " SELECT * FROM found")
def a3_hamming_locate(spark, d):
    """Words with a changed symbol within two mismatches in the items."""
    return approximate.locate_hamming(items(spark, d), changed_words(spark, d), 2)


@query(SQL_HAMMING + " SELECT pat_id, count(err) AS n FROM changed LEFT JOIN found USING (pat_id) GROUP BY pat_id")
def a1_hamming_count(spark, d):
    return approximate.count_hamming(items(spark, d), changed_words(spark, d), 2)


@query(SQL_HAMMING + " SELECT pat_id, count(err) FILTER (err = 0) AS c_0, count(err) FILTER (err = 1) AS c_1, count(err) FILTER (err = 2) AS c_2 FROM changed LEFT JOIN found USING (pat_id) GROUP BY pat_id")
def a2_hamming_histogram(spark, d):
    return approximate.histogram_hamming(items(spark, d), changed_words(spark, d), 2)


@query(
    f"""WITH {SQL_DOCS}, {SQL_ITEMS}, p AS (
    SELECT doc_id AS pat_id, length(text) AS m, substring(text, 1, (length(text) + 1) // 2 - 1) || '_' || substring(text, (length(text) + 1) // 2 + 1) AS pattern FROM items
), seeds AS (
    SELECT pat_id, off, substring(pattern, off + 1, 16) AS w FROM (SELECT *, unnest([0, m // 3, 2 * m // 3]) AS off FROM p)
), {sql_windows('docs', 16)}, cand AS (
    SELECT DISTINCT doc_id, pat_id, pos - off AS pos FROM win JOIN seeds USING (w) WHERE pos >= off
), v AS (
    SELECT doc_id, pat_id, pos, m, string_split(pattern, '') AS p, string_split(substring(text, pos + 1, m), '') AS x FROM cand JOIN p USING (pat_id) JOIN docs USING (doc_id)
)
SELECT doc_id, pat_id, pos, m::INTEGER AS len, len(list_filter(range(1, m + 1), lambda i: p[i] <> x[i]))::INTEGER AS err FROM v
WHERE len(x) = m AND len(list_filter(range(1, m + 1), lambda i: p[i] <> x[i])) <= 2"""
)
def a3_hamming_documents(spark, d):
    """Items with a changed symbol within two mismatches in all documents."""
    middle = F.expr("overlay(pattern placing '_' from int((char_length(pattern) + 1) / 2) for 1)")
    return approximate.locate_hamming(documents(spark, d), item_patterns(spark, d).select("pat_id", middle.alias("pattern")), 2)


SQL_EDIT = f"""WITH {SQL_NAMES}, places AS (SELECT p_partkey AS doc_id, p_name AS text, unnest(range(0, length(p_name))) AS pos FROM part),
w AS (SELECT doc_id, pos, n, substring(text, pos + 1, n) AS w FROM (SELECT *, unnest(range(1, length(text) - pos + 1)) AS n FROM places)),
e AS (SELECT doc_id, pat_id, pos, n, levenshtein(w, pattern) AS err FROM w JOIN names ON abs(n - length(pattern)) <= 1),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, pat_id, pos ORDER BY err, n) AS k FROM e WHERE err <= 1),
found AS (SELECT doc_id, pat_id, pos, n::INTEGER AS len, err::INTEGER AS err FROM best WHERE k = 1)"""


@query(SQL_EDIT + " SELECT * FROM found")
def a5_edit_locate(spark, d):
    """Words of part names with a symbol put in, within one edit in all names."""
    return approximate.locate_edit(parts(spark, d), changed_names(spark, d), 1)


@query()
def a5_edit_documents(spark, d):
    """Items with a changed symbol within two edits in all documents, with their scripts."""
    middle = F.expr("overlay(pattern placing '_' from int((char_length(pattern) + 1) / 2) for 1)")
    found = approximate.locate_edit(documents(spark, d), item_patterns(spark, d).select("pat_id", middle.alias("pattern")), 2, cigars=True)
    return found.drop("runs")


@query()
def a10_without_redundant(spark, d):
    return approximate.without_redundant(approximate.locate_edit(parts(spark, d), changed_names(spark, d), 1), 1)


@query("SELECT 0::BIGINT AS n_not_covered")
def a11_not_covered(spark, d):
    """Hits that the filtered ones do not cover: none."""
    found = approximate.locate_edit(parts(spark, d), changed_names(spark, d), 1)
    return approximate.not_covered(found, approximate.without_redundant(found, 1), 1).agg(F.count("*").alias("n_not_covered"))


@query(
    """WITH v AS (SELECT l_suppkey AS b, l_suppkey + l_linenumber AS e, l_linenumber::BIGINT AS len, (l_partkey % 3)::BIGINT AS err FROM lineitem),
r AS (SELECT len, err, unnest(range(b, e + 1)) AS i FROM v)
SELECT i, len, err FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY err, len DESC) AS k FROM r) WHERE k = 1"""
)
def a12_effective_intervals(spark, d):
    rows = tables.read(spark, d, "lineitem").select(
        F.col("l_suppkey").cast("long").alias("b"), (F.col("l_suppkey") + F.col("l_linenumber")).cast("long").alias("e"),
        F.col("l_linenumber").cast("long").alias("len"), (F.col("l_partkey") % 3).cast("long").alias("err"),
    )
    return approximate.effective_intervals(rows)


def aligned(spark, d, *more):
    """Both strands of the items' bases, a symbol changed, aligned to the documents' bases; ``more`` go with the hits."""
    turned = F.expr("overlay(text placing 'A' from int(char_length(text) / 2) for 1)")
    reads = bases(items(spark, d)).select(F.col("doc_id").alias("pat_id"), turned.alias("pattern"))
    return reads, approximate.align_reads(bases(documents(spark, d)).select("*", *more), reads, 2)


@query()
def a13_aligned_reads(spark, d):
    return approximate.ranked_hits(aligned(spark, d)[1].drop("runs"))


@query(
    """SELECT family, k::INTEGER AS k, (k + more)::INTEGER AS parts, (k + 1)::INTEGER AS n_searches, 0::INTEGER AS n_uncovered
FROM (VALUES ('pigeonhole', 1), ('suffix_filter', 1), ('zero_one', 2), ('first_exact', 1)) f(family, more), range(7) r(k)"""
)
def h_schemes(spark, d):
    """The families of search schemes and the error spreads they leave uncovered."""
    made = [(name, k, s.parts, len(s.searches), len(s.uncovered())) for name, make in schemes.FAMILIES.items() for k in range(7) for s in [make(k)]]
    return spark.createDataFrame(made, "family string, k int, parts int, n_searches int, n_uncovered int")


@query("SELECT l_orderkey, l_linenumber, rank() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey, l_suppkey + l_linenumber DESC, l_partkey) AS place FROM lineitem")
def o2_context_order(spark, d):
    rows = tables.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("b"), (F.col("l_suppkey") + F.col("l_linenumber")).alias("e"), F.col("l_partkey").alias("len"))
    return approximate.in_context_order(rows, "l_orderkey").select("l_orderkey", "l_linenumber", "place")


# ---- scalar functions


@query("SELECT p_partkey, translate(reverse(upper(p_name)), 'ACGT', 'TGCA') AS turned FROM part")
def f1_reverse_complement(spark, d):
    return tables.read(spark, d, "part").select("p_partkey", reverse_complement(F.upper("p_name")).alias("turned"))


@query("SELECT p_partkey, regexp_replace(translate(p_name, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), '[^ACGT]', 'N', 'g') AS body FROM part")
def f2_normalised(spark, d):
    return tables.read(spark, d, "part").select("p_partkey", normalised_bases(F.col("p_name")).alias("body"))


def name_pairs(spark, d):
    """Part names beside the next part's, by key."""
    rows = tables.read(spark, d, "part").select("p_partkey", "p_name")
    following = rows.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("following"))
    return rows.join(following, "p_partkey")


SQL_PAIRS = "WITH pairs AS (SELECT a.p_partkey, a.p_name, b.p_name AS following FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1)"


@query(SQL_PAIRS + " SELECT p_partkey, CASE WHEN length(p_name) = length(following) THEN least(hamming(p_name, following), 4) END::INTEGER AS dist FROM pairs WHERE length(p_name) = length(following)")
def f3_hamming(spark, d):
    pairs = name_pairs(spark, d).where(F.char_length("p_name") == F.char_length("following"))
    return pairs.select("p_partkey", hamming_bounded(F.col("p_name"), F.col("following"), 3).alias("dist"))


@query(SQL_PAIRS + " SELECT p_partkey, least(levenshtein(p_name, following), 6)::INTEGER AS dist FROM pairs")
def f4_edit(spark, d):
    return name_pairs(spark, d).select("p_partkey", edit_bounded(F.col("p_name"), F.col("following"), 5).alias("dist"))


@query(
    SQL_PAIRS
    + """, c AS (SELECT p_partkey, p_name, following, unnest(range(1, length(following) + 1)) AS n FROM pairs),
e AS (SELECT p_partkey, n, levenshtein(p_name, left(following, n)) AS err FROM c),
b AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY err, n) AS k FROM e WHERE err <= 10)
SELECT p_partkey, coalesce(b.err, 11)::INTEGER AS err, coalesce(b.n, 0)::INTEGER AS len FROM pairs LEFT JOIN b USING (p_partkey) WHERE k = 1 OR k IS NULL"""
)
def f5_best_prefix(spark, d):
    """The prefix of the next name that is nearest to each name, within ten edits."""
    return name_pairs(spark, d).select("p_partkey", edit_window(10)("p_name", "following").alias("a")).select("p_partkey", "a.err", "a.len")


@query()
def f9_hamming_scripts(spark, d):
    """Words with a changed symbol within two mismatches in the items, with their scripts."""
    return approximate.locate_hamming(items(spark, d), changed_words(spark, d), 2, cigars=True).drop("runs")


@query()
def f6_edit_scripts(spark, d):
    return name_pairs(spark, d).select("p_partkey", edit_alignment(10)("p_name", "following").alias("a")).select("p_partkey", "a.cigar", "a.md")


@query(
    SQL_PAIRS
    + """, x AS (SELECT p_partkey, p_name, following, unnest(range(0, least(length(p_name), length(following)) + 1)) AS i FROM pairs)
SELECT p_partkey, max(i)::INTEGER AS lcp FROM x WHERE left(p_name, i) = left(following, i) GROUP BY p_partkey"""
)
def f15_common_prefix(spark, d):
    return name_pairs(spark, d).select("p_partkey", common_prefix(F.col("p_name"), F.col("following")).alias("lcp"))


@query(SQL_PAIRS + " SELECT p_partkey, p_name < following AS less FROM pairs")
def f15_lex_less(spark, d):
    return name_pairs(spark, d).select("p_partkey", lex_less(F.col("p_name"), F.col("following")).alias("less"))


# ---- aggregations


@query(SQL_WORD_HITS + " SELECT count(*) AS total, count(*) // (SELECT count(*) FROM words) AS average FROM hits")
def g1_total(spark, d):
    words = word_patterns(spark, d)
    total = exact.count(documents(spark, d), words).agg(F.sum("n").alias("total"), F.count("*").alias("k"))
    return total.select("total", F.expr("total div k").alias("average"))


@query(SQL_EDIT + " SELECT (sum(pos + err) + count(*))::BIGINT AS checksum FROM found")
def g3_checksum(spark, d):
    found = approximate.locate_edit(parts(spark, d), changed_names(spark, d), 1)
    return found.agg((F.sum(F.col("pos") + F.col("err")) + F.count("*")).alias("checksum"))


SQL_SYMBOLS = f"WITH {SQL_DOCS}, s AS (SELECT unnest(string_split(text, '')) AS symbol FROM docs WHERE text <> ''), c AS (SELECT symbol, count(*) AS n FROM s GROUP BY symbol)"


@query(f"WITH {SQL_DOCS}, {sql_windows('docs', 1)}, c AS (SELECT w AS symbol, count(*) AS n FROM win GROUP BY w) SELECT symbol, n, coalesce(sum(n) OVER (ORDER BY symbol ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM c")
def g6_symbols_cumulative(spark, d):
    """Symbols of all documents: frequency, and how many are smaller."""
    return suffix.symbol_counts(symbols(documents(spark, d)))


@query(f"WITH {SQL_DOCS}, {sql_windows('docs', 1)} SELECT w AS symbol, count(*) AS n FROM win GROUP BY w")
def g5_symbol_freq(spark, d):
    return symbols(documents(spark, d)).groupBy("symbol").agg(F.count("*").alias("n"))


@query(f"WITH {SQL_SA} SELECT doc_id, max(run) + 1 AS n_runs FROM full_t GROUP BY doc_id")
def g7_num_runs(spark, d):
    return full_table(spark, d).groupBy("doc_id").agg((F.max("run") + 1).alias("n_runs"))


@query(f"WITH {SQL_SA} SELECT doc_id, dsa, count(*) AS n FROM full_t GROUP BY ALL")
def g8_dsa_freq(spark, d):
    return full_table(spark, d).groupBy("doc_id", "dsa").agg(F.count("*").alias("n"))


@query(f"WITH {SQL_SA} SELECT doc_id, count(*) AS n, max(run) + 1 AS n_runs, count(DISTINCT bwt) AS n_symbols, count(*) / (max(run) + 1) AS per_run FROM full_t GROUP BY doc_id")
def g9_sizes(spark, d):
    return suffix.sizes(full_table(spark, d))


# ---- suffix-array algebra


@query(f"WITH {SQL_SA} SELECT doc_id, i, sa FROM sa")
def w1_sa(spark, d):
    return array_table(spark, d).select("doc_id", "i", "sa")


@query(f"WITH {SQL_SA} SELECT doc_id, i, sa FROM sa")
def w1_sa_by_doubling(spark, d):
    """The same array by prefix doubling."""
    return suffix.suffix_array_by_doubling(symbols(items(spark, d)), scratch.stored)


@query(f"WITH {SQL_SA} SELECT doc_id, i, bwt, run, lf, phi, phi_inv, dsa FROM full_t")
def w2_table(spark, d):
    """BWT, runs, LF, Phi, its inverse and differences of every item."""
    return full_table(spark, d).select("doc_id", "i", "bwt", "run", "lf", "phi", "phi_inv", "dsa")


@query(f"WITH {SQL_SA} SELECT doc_id, run, min(bwt) AS sym, min(i) AS start, count(*) AS len, min_by(sa, i) AS first_sa, max_by(sa, i) AS last_sa, min(lf) AS q FROM full_t GROUP BY ALL")
def w3_runs(spark, d):
    return suffix.runs(full_table(spark, d))


@query(f"WITH {SQL_SA} SELECT doc_id, i, sa FROM sa WHERE i % 8 = 0")
def w8_samples(spark, d):
    """Every eighth suffix of each array: a sampling operator."""
    return suffix.samples(array_table(spark, d), 8).select("doc_id", "i", "sa")


@query(f"WITH {SQL_SA} SELECT doc_id, i, bwt AS sym, row_number() OVER (PARTITION BY doc_id, bwt ORDER BY i) - 1 AS rank FROM sa")
def w10_rank(spark, d):
    return rank_select.rank(array_table(spark, d).select("doc_id", "i", F.col("bwt").alias("sym")))


@query(f"WITH {SQL_SA} SELECT doc_id, bwt AS sym, row_number() OVER (PARTITION BY doc_id, bwt ORDER BY i) AS k, i FROM sa")
def w10_select(spark, d):
    return rank_select.select(array_table(spark, d).select("doc_id", "i", F.col("bwt").alias("sym")))


@query(
    f"""WITH {SQL_SA} SELECT doc_id, i, max(CASE WHEN bwt = 'e' THEN i END) OVER (PARTITION BY doc_id ORDER BY i) AS pred,
min(CASE WHEN bwt = 'e' THEN i END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS succ FROM sa"""
)
def w11_pred_succ(spark, d):
    return rank_select.neighbours(array_table(spark, d).select("doc_id", "i", F.col("bwt").alias("sym")), "e")


@query(
    f"""WITH {SQL_SA}, p AS (SELECT doc_id, i, sa, suffix, coalesce(lag(suffix) OVER (PARTITION BY doc_id ORDER BY i), '') AS prev FROM sa),
x AS (SELECT doc_id, sa, suffix, prev, unnest(range(0, least(length(suffix), length(prev)) + 1)) AS n FROM p)
SELECT doc_id, sa AS pos, max(n)::INTEGER AS plcp FROM x WHERE left(suffix, n) = left(prev, n) GROUP BY ALL"""
)
def w14_plcp(spark, d):
    return suffix.plcp(array_table(spark, d, True))


@query(f"WITH {SQL_SA} SELECT doc_id, sa AS pos, i FROM sa")
def w13_inverse(spark, d):
    return suffix.inverse(array_table(spark, d))


@query(f"WITH {SQL_SA} SELECT doc_id, lf AS i, bwt AS f FROM full_t")
def e18_f_column(spark, d):
    return suffix.f_column(full_table(spark, d))


@query(f"WITH {SQL_SA} SELECT doc_id, lf AS i, i AS fl FROM full_t")
def e18_fl(spark, d):
    return suffix.fl(full_table(spark, d))


# ---- lookups


@query(
    """WITH t AS (SELECT conv_id * 1000 + turn AS seq_id, length(coalesce(text, '')) AS length FROM conversations),
s AS (SELECT *, coalesce(sum(length + 1) OVER (ORDER BY seq_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS start FROM t)
SELECT event_id, event_id * 97 AS pos, CASE WHEN event_id * 97 < start + length THEN seq_id END AS seq_id, CASE WHEN event_id * 97 < start + length THEN (event_id * 97 - start)::BIGINT END AS local
FROM events ASOF LEFT JOIN s ON event_id * 97 >= s.start"""
)
def j1_sequence_of(spark, d):
    """Global positions (one an event) looked up among the conversations' turns, as if joined to one text."""
    at = tables.read(spark, d, "events").select("event_id", (F.col("event_id") * 97).alias("pos"))
    return intervals.sequence_of(at, intervals.collection(turns(spark, d)))


@query(
    """WITH t AS (SELECT conv_id * 1000 + turn AS seq_id, length(coalesce(text, '')) AS length FROM conversations)
SELECT seq_id, (coalesce(sum(length + 1) OVER (ORDER BY seq_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1)::BIGINT AS start, length::BIGINT AS length FROM t"""
)
def j2_sequences(spark, d):
    return intervals.collection(turns(spark, d))


@query(
    """WITH t AS (SELECT conv_id * 1000 + turn AS seq_id, length(coalesce(text, '')) AS length FROM conversations),
s AS (SELECT coalesce(sum(length + 1) OVER (ORDER BY seq_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT + 1 AS start FROM t)
SELECT event_id, a.start AS at_most, b.start AS below, c.start AS at_least, d.start AS above FROM events
ASOF LEFT JOIN s a ON event_id * 97 >= a.start ASOF LEFT JOIN s b ON event_id * 97 > b.start ASOF LEFT JOIN s c ON event_id * 97 <= c.start ASOF LEFT JOIN s d ON event_id * 97 < d.start"""
)
def j3_searches(spark, d):
    """The turns' starts around the events' places: the four binary searches."""
    rows = tables.read(spark, d, "events").select("event_id", (F.col("event_id") * 97).alias("pos"))
    starts = intervals.collection(turns(spark, d))
    for relation, name in (("max<=", "at_most"), ("max<", "below"), ("min>=", "at_least"), ("min>", "above")):
        rows = intervals.nearest(rows, starts, "pos", "start", relation, name)
    return rows.drop("pos")


@query(f"WITH {SQL_SA}, {SQL_WORDS} SELECT doc_id, pat_id, count(*) FILTER (suffix < pattern) AS lower, count(*) FILTER (suffix < pattern OR starts_with(suffix, pattern)) AS upper FROM sa, words GROUP BY ALL")
def j6_boundaries(spark, d):
    """Where each word would stand in each item's array."""
    return suffix.boundaries(array_table(spark, d, True), word_patterns(spark, d))


SQL_MOVE = SQL_SA + ", mv AS (SELECT doc_id, run AS x, min(i) AS p, count(*) AS len, min(lf) AS q FROM full_t GROUP BY ALL)"


@query(f"WITH {SQL_MOVE} SELECT a.doc_id, a.x, a.p, a.len, a.q, b.x AS idx, a.q - b.p AS offs FROM mv a JOIN mv b ON a.doc_id = b.doc_id AND a.q >= b.p AND a.q < b.p + b.len")
def j5_move_structure(spark, d):
    return intervals.move_structure(full_table(spark, d))


@query(f"WITH {SQL_MOVE} SELECT f.doc_id, f.i, f.run AS x, f.lf AS target FROM full_t f")
def r6_move(spark, d):
    """Every position of every item's BWT moved by the structure: the LF-mapping."""
    table = full_table(spark, d)
    return intervals.moved(table.select("doc_id", "i"), intervals.move_structure(table))


@query(f"WITH {SQL_SA} SELECT doc_id, i, lf AS target FROM full_t")
def r7_balanced_move(spark, d):
    """The same by a balanced structure."""
    table = scratch.stored(full_table(spark, d))
    structure = intervals.balanced(intervals.move_structure(table), 2, scratch.stored)
    return intervals.moved(table.select("doc_id", "i"), structure).select("doc_id", "i", "target")


# ---- retrieval and compressed arrays


@query("SELECT doc_id, substring(coalesce(text, ''), 101, 200) AS part FROM documents")
def r1_text_range(spark, d):
    return suffix.text_range(documents(spark, d), 100, 299)


@query("SELECT item_id AS doc_id, text FROM benchmark")
def r1_reverted(spark, d):
    """The items rebuilt from their arrays and transforms."""
    return suffix.reverted(array_table(spark, d))


@query(f"WITH {SQL_SA} SELECT doc_id, i, bwt FROM sa WHERE i BETWEEN 10 AND 40")
def r2_bwt_range(spark, d):
    return suffix.table_range(array_table(spark, d), 10, 40, "bwt")


@query(f"WITH {SQL_SA} SELECT doc_id, i, sa FROM sa WHERE i BETWEEN 10 AND 40")
def r3_sa_range(spark, d):
    return suffix.table_range(array_table(spark, d), 10, 40, "sa")


@query(f"WITH {SQL_SA} SELECT doc_id, i, sa FROM sa")
def r10_rlz(spark, d):
    """The items' arrays encoded by relative Lempel-Ziv and decoded."""
    table = full_table(spark, d)
    reference = scratch.stored(compressed.reference_of(table))
    return compressed.rlz_decoded(compressed.rlz(table, reference), reference)


@query(f"WITH {SQL_SA} SELECT doc_id, i, sa FROM sa")
def r12_lz_end(spark, d):
    """The items' arrays encoded by LZ-End and decoded."""
    return compressed.lz_end_decoded(compressed.lz_end(full_table(spark, d)))


SQL_RANGES = f"""WITH {SQL_SA}, q AS (SELECT event_id AS query, event_id % (SELECT count(*) FROM items) AS doc_id, (event_id * 31) % 60 AS l FROM events),
x AS (SELECT query, doc_id, unnest(range(l, l + 7)) AS i FROM q)
SELECT query, doc_id, i, sa FROM x JOIN sa USING (doc_id, i)"""


def ranges(spark, d):
    """Ranges of seven places of the items' arrays, one an event."""
    n = items(spark, d).count()
    left = (F.col("event_id") * 31) % 60
    return tables.read(spark, d, "events").select(F.col("event_id").alias("query"), (F.col("event_id") % n).alias("doc_id"), left.alias("left"), (left + 6).alias("right"))


@query(SQL_RANGES)
def r18_random_access(spark, d):
    """The ranges read from the items' arrays."""
    return compressed.random_access(array_table(spark, d), ranges(spark, d))


@query(SQL_RANGES)
def r4_rlz_ranges(spark, d):
    """The same ranges decoded from the phrases that they meet."""
    table = full_table(spark, d)
    reference = scratch.stored(compressed.reference_of(table))
    phrases = compressed.with_bases(compressed.rlz(table, reference), table)
    return compressed.rlz_ranges(phrases, reference, ranges(spark, d))


@query(f"WITH {SQL_SA}, {SQL_WORDS} SELECT doc_id, pat_id, sa AS pos FROM sa JOIN words ON starts_with(suffix, pattern)")
def e17_rlz_locate(spark, d):
    """Words located in the items: their ranges of suffixes, whose places are decoded from phrases."""
    table = full_table(spark, d)
    reference = scratch.stored(compressed.reference_of(table))
    phrases = compressed.with_bases(compressed.rlz(table, reference), table)
    found = suffix.intervals(array_table(spark, d, True), word_patterns(spark, d))
    found = found.select(F.col("pat_id").alias("query"), "doc_id", F.col("b").alias("left"), F.col("e").alias("right"))
    return compressed.rlz_ranges(phrases, reference, found).select("doc_id", F.col("query").alias("pat_id"), F.col("sa").alias("pos"))


@query(SQL_RANGES)
def r13_lz_end_ranges(spark, d):
    """The same ranges from LZ-End phrases, copies followed to their sources."""
    table = scratch.stored(full_table(spark, d))
    phrases = compressed.lz_end_with_bases(compressed.lz_end(table), table)
    return compressed.lz_end_ranges(phrases, ranges(spark, d), scratch.stored)


@query(
    f"""WITH {SQL_SA}, q AS (SELECT event_id AS query, event_id % (SELECT count(*) FROM items) AS doc_id, (event_id * 31) % 60 AS start, event_id % 2 = 1 AS turned,
event_id % 5 AS skip, event_id % 9 AS n FROM events),
o AS (SELECT *, unnest(range(0, n)) AS o FROM q),
x AS (SELECT query, doc_id, CASE WHEN turned THEN start - skip - o ELSE start + skip + o END AS i FROM o)
SELECT query, doc_id, i, sa FROM x JOIN sa USING (doc_id, i)"""
)
def r9_cursor(spark, d):
    """Cursors on the items' phrases: every second one turned, up to four places skipped and eight reported."""
    table = scratch.stored(full_table(spark, d))
    reference = scratch.stored(compressed.reference_of(table))
    phrases = compressed.with_bases(compressed.rlz(table, reference), table)
    asked = ranges(spark, d).select("query", "doc_id", F.col("left").alias("at"), (F.col("query") % 2 == 1).alias("turned"), (F.col("query") % 5).alias("skip"), (F.col("query") % 9).alias("n"))
    sizes = table.groupBy("doc_id").agg(F.count("*").alias("n_rows"))
    return compressed.rlz_ranges(phrases, reference, compressed.cursor_ranges(asked, sizes))


@query("SELECT kind, item_id AS doc_id, text FROM benchmark, (VALUES ('lz_end'), ('rlz')) k(kind)")
def r17_converted(spark, d):
    """The items' texts as both conversions read them off the runs."""
    table = scratch.stored(full_table(spark, d))
    runs, reference = scratch.stored(suffix.runs(table)), scratch.stored(compressed.reference_of(table))
    rlz = compressed.converted(runs, compressed.rlz(table, reference), reference)["texts"]
    lz_end = compressed.converted(runs, compressed.lz_end(table))["texts"]
    return rlz.select(F.lit("rlz").alias("kind"), "doc_id", "text").union(lz_end.select(F.lit("lz_end").alias("kind"), "doc_id", "text"))


@query(
    f"""WITH {SQL_SA}, x AS (SELECT doc_id, run, any_value(bwt) AS sym, count(*) AS len FROM full_t GROUP BY doc_id, run)
SELECT doc_id, sum(len)::BIGINT AS n_rows, count(*) AS n_runs, max(len) AS longest, count(DISTINCT sym) AS n_symbols FROM x GROUP BY doc_id"""
)
def r19_inspected(spark, d):
    return compressed.inspected(suffix.runs(full_table(spark, d)))


@query()
def x3_sampled_patterns(spark, d):
    """A hundred patterns of twenty symbols drawn from the documents: a sampling operator."""
    return sample_patterns(documents(spark, d), 100, 20, forbidden="\n")


# ---- result lines


@query(SQL_WORD_HITS + " SELECT pat_id, 'pat' || pat_id || chr(9) || coalesce(n, 0) AS line FROM words LEFT JOIN (SELECT pat_id, count(*) AS n FROM hits GROUP BY pat_id) USING (pat_id)")
def k1_counts(spark, d):
    return records.counts(exact.count(documents(spark, d), word_patterns(spark, d)))


@query(SQL_HAMMING + " SELECT pat_id, concat_ws(chr(9), 'pat' || pat_id, count(err) FILTER (err = 0), count(err) FILTER (err = 1), count(err) FILTER (err = 2)) AS line FROM changed LEFT JOIN found USING (pat_id) GROUP BY pat_id")
def k2_histogram(spark, d):
    return records.histogram(approximate.histogram_hamming(items(spark, d), changed_words(spark, d), 2), 2)


@query(f"WITH {SQL_ITEMS}, {SQL_WORDS}, {sql_windows('items', 6, 'words.pattern')}, hits AS (SELECT doc_id, pat_id, pos FROM win JOIN words ON w = left(pattern, 6) AND starts_with(t, pattern)) SELECT pat_id, coalesce(string_agg(pos || ' ', '' ORDER BY pos), '') AS line FROM words LEFT JOIN hits USING (pat_id) GROUP BY pat_id")
def k3_positions(spark, d):
    words = word_patterns(spark, d)
    return records.positions(exact.locate(items(spark, d), words), words)


@query(SQL_EDIT + " SELECT pat_id, coalesce(string_agg('(pos=' || pos || ' len=' || len || ' err=' || err || ') ', '' ORDER BY pos, len, err), '') AS line FROM names LEFT JOIN found USING (pat_id) GROUP BY pat_id")
def k4_approximate_positions(spark, d):
    names = changed_names(spark, d)
    return records.approximate_positions(approximate.locate_edit(parts(spark, d), names, 1), names)


@query(
    SQL_STRANDS
    + """, r AS (SELECT *, row_number() OVER (PARTITION BY pat_id ORDER BY strand, doc_id, pos) AS rank, count(*) OVER (PARTITION BY pat_id) AS n FROM found)
SELECT pat_id, rank, concat_ws(chr(9), 'pat' || pat_id, (CASE WHEN rank = 1 THEN 0 ELSE 256 END + CASE WHEN strand = '-' THEN 16 ELSE 0 END), 'doc' || doc_id, pos + 1,
       CASE WHEN rank = 1 AND n = 1 THEN 60 ELSE 0 END, '12=', '*', '0', '0', '*', '*') AS line FROM r"""
)
def k5_sam_exact(spark, d):
    names = documents(spark, d).select("doc_id", F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("name"))
    return records.sam_exact(strands(spark, d), base_patterns(spark, d), names)


@query(SQL_STRANDS + " SELECT pat_id, strand, doc_id, pos, concat_ws(chr(9), 'doc' || doc_id, pos, pos + 12, 'pat' || pat_id, '0', strand) AS line FROM found")
def k6_bed(spark, d):
    names = documents(spark, d).select("doc_id", F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("name"))
    return records.bed(strands(spark, d), base_patterns(spark, d), names)


def named_documents(spark, d):
    return bases(documents(spark, d)).select("doc_id", F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("name"), F.char_length("text").alias("length"))


def named_reads(reads):
    return reads.select("pat_id", F.concat(F.lit("read"), F.col("pat_id").cast("string")).alias("name"), "pattern", F.repeat(F.lit("I"), F.char_length("pattern")).alias("quality"))


@query()
def k7_sam_approximate(spark, d):
    reads, hits = aligned(spark, d, F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("name"))
    return records.sam_approximate(approximate.ranked_hits(hits.drop("runs")), named_reads(reads), with_sequence=True)


@query()
def k8_paf(spark, d):
    reads, hits = aligned(spark, d)
    return records.paf(hits, named_reads(reads), named_documents(spark, d))


@query(f"WITH {SQL_ITEMS} SELECT doc_id AS at, '@SQ' || chr(9) || 'SN:item' || doc_id || chr(9) || 'LN:' || length(text) AS line FROM items UNION ALL SELECT -1, '@HD' || chr(9) || 'VN:1.6' || chr(9) || 'SO:unsorted' UNION ALL SELECT 4611686018427387904, '@PG' || chr(9) || 'ID:lexiloom' || chr(9) || 'PN:lexiloom' || chr(9) || 'CL:'")
def k13_sam_header(spark, d):
    rows = items(spark, d).select(F.col("doc_id").alias("seq_id"), F.concat(F.lit("item"), F.col("doc_id").cast("string")).alias("name"), F.char_length("text").alias("length"))
    return records.sam_header(rows)
