"""Registered queries of the subpackage: thin digests of the operators over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakefold.functions.arrays import let

from . import decontaminate, fst, minhash, packing, phrases, quality, repair, runs, sharding, simple8b, suffix_tree, toxicity, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(
    "op7_decontaminate",
    r"""
    WITH d AS (SELECT doc_id, regexp_extract_all("""
    + _LOWER.format("coalesce(text, '')")
    + r""", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM documents),
    b AS (SELECT CAST(item_id AS VARCHAR) item, regexp_extract_all("""
    + _LOWER.format("text")
    + r""", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
    bw AS (SELECT DISTINCT item, least(10, len(w)) k, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') g
           FROM (SELECT item, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) i FROM b WHERE len(w) > 0)),
    ks AS (SELECT DISTINCT k FROM bw),
    dw AS (SELECT doc_id, i, k, array_to_string(w[i : i + k - 1], ' ') g
           FROM (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) i FROM d, ks WHERE len(w) >= k)),
    h AS (SELECT dw.doc_id, dw.i, dw.k, bw.item FROM dw JOIN bw ON dw.k = bw.k AND dw.g = bw.g),
    p AS (SELECT doc_id, count(DISTINCT p) n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + k - 1)) p FROM h) GROUP BY 1),
    s AS (SELECT doc_id, count(DISTINCT item) n_items, string_agg(DISTINCT item, ',' ORDER BY item) ids FROM h GROUP BY 1)
    SELECT d.doc_id, CAST(len(d.w) AS BIGINT) n_words, coalesce(p.n_hit, 0) n_hit, coalesce(s.n_items, 0) n_items,
           sha256(coalesce(s.ids, '')) items_sha256, coalesce(p.n_hit, 0) > 0 contaminated
    FROM d LEFT JOIN p USING (doc_id) LEFT JOIN s USING (doc_id)
    """,
)
def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test windows found in every document."""
    found = decontaminate.find_test_windows(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "leak.n_words",
        "leak.n_hit",
        F.size("leak.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("leak.items", ","), 256).alias("items_sha256"),
        (F.col("leak.n_hit") > 0).alias("contaminated"),
    )


@query("op9_shard")
def op9_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents shuffled into 40 shards whose row counts differ by at most one."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    placed = sharding.shard_rows(rows, 40, order=["doc_id", "size", "text_crc32"], seed=20240901)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op4_pack")
def op4_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as byte-level ids, packed into sequences of 1024."""
    pieces = packing.pack_texts(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end=0, capacity=1024)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op6_simple8b")
def op6_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token-id files of all documents, written and read back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return simple8b.read_ids(simple8b.write_ids(docs, tokenizer_path("word_bpe_49k.json"), keeps_blanks=False, lower=True, end=1))


@query("op8_count_tokens")
def op8_count_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document by the compiled transducer."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = fst.count_tokens(docs, tokenizer_path("piece_bpe_32k.model"))
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    return counted.select("doc_id", size.alias("n_bytes"), "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


@query(
    "op3_warc",
    """
    WITH p AS (SELECT page_id, coalesce(html, '') html FROM pages),
    h AS (SELECT page_id, CAST(strlen(html) AS BIGINT) payload_bytes, sha1(html) payload_digest FROM p),
    g AS (SELECT payload_digest, max(page_id) top FROM h WHERE payload_bytes >= 1000 GROUP BY 1)
    SELECT h.page_id, h.payload_bytes, h.payload_digest,
           CASE WHEN g.top > h.page_id THEN 'revisit' ELSE 'response' END record_type,
           CASE WHEN g.top > h.page_id THEN g.top END refers_to
    FROM h LEFT JOIN g ON g.payload_digest = h.payload_digest AND h.payload_bytes >= 1000
    """,
)
def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as deduplicated archives and read back."""
    manifest = warc.write_archives(table(spark, sf_dir, "pages"), min_bytes=1000)
    return warc.read_archives(manifest, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op1_quality")
def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and log-likelihood ratio of every document."""
    scored = quality.score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def _fourth(key: str = "doc_id"):
    return F.crc32(F.col(key).cast("string").cast("binary")) % 4


@query("op2_toxicity")
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the rows that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon = toxicity.fit(docs, table(spark, sf_dir, "labels").where(_fourth() != 2))
    scored = toxicity.score_texts(docs, lexicon)
    return scored.select("doc_id", (_fourth() == 2).alias("held_out"), "toxicity.score", F.when(F.col("toxicity.score") >= toxicity.CUT, 1).otherwise(0).alias("predicted"))


@query("op10_suffix_tree")
def op10_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram base and suffix-tree score of every document."""
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0
    scored = suffix_tree.score_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op5_near_duplicates")
def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of near copies that each document belongs to."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


# CRC-32 of short ASCII strings: the byte table from its polynomial, then a fold over the bytes.
_CRC_TABLE = """crc AS (SELECT list(v ORDER BY i) tab FROM (SELECT i, list_reduce(list_concat([i], range(8)),
                lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) v FROM range(256) t(i)))"""
_CRC = """xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split({0}, ''), lambda s: CAST(unicode(s) AS BIGINT))),
                lambda c, b: xor(c >> 8, tab[1 + (xor(c, b) & 255)])), 4294967295)"""


def _id_checksum(key: str = "doc_id"):
    return F.crc32(F.col(key).cast("string").cast("binary"))


def planted_periods(docs: DataFrame) -> DataFrame:
    """Documents of which a tenth repeat their end: the words from ``a`` on go round in ``p`` words.

    A null id plants nothing.
    """
    h = _id_checksum()
    g = F.floor(h / 10)

    def round_and_round(words):
        n = F.size(words)
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        place = let(F.struct(a.cast("int").alias("a"), p.cast("int").alias("p")), lambda b: F.transform(
            F.sequence(F.lit(0), n - 1), lambda i: F.get(words, F.when(i < b["a"], i).otherwise(b["a"] + (i - b["a"]) % b["p"]))))
        return F.when(n > 0, F.array_join(place, " ")).otherwise(F.lit(""))

    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    return docs.select("doc_id", F.when(h % 10 == 0, let(words, round_and_round)).otherwise(F.col("text")).alias("text"))


@query(
    "op12_periodic_runs",
    "WITH "
    + _CRC_TABLE
    + r""",
    d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w0, """
    + _CRC.format("CAST(doc_id AS VARCHAR)")
    + r""" h FROM documents, crc),
    a AS (SELECT doc_id, w0, h, len(w0) n, h // 10 g FROM d),
    b AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: CASE WHEN i < g % n THEN w0[i + 1]
                 ELSE w0[1 + g % n + (i - g % n) % (1 + (n - g % n) // (3 + g % 8))] END) ELSE w0 END w FROM a),
    k AS (SELECT doc_id, n, i, hash(array_to_string(w[i + 1 : i + 16], ' ')) g FROM (SELECT doc_id, n, w, unnest(range(n - 15)) i FROM b WHERE n >= 24)),
    p AS (SELECT x.doc_id, x.i, y.i - x.i q FROM k x JOIN k y ON x.doc_id = y.doc_id AND x.g = y.g AND y.i > x.i AND 3 * (y.i - x.i) <= x.n),
    s AS (SELECT doc_id, q, min(i) start, max(i) - min(i) + 16 + q length
          FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) island FROM p) GROUP BY doc_id, q, island),
    r AS (SELECT doc_id, start, length, min(q) period FROM s WHERE length >= greatest(24, 3 * q) GROUP BY 1, 2, 3),
    t AS (SELECT doc_id, count(*) n_runs, sha256(string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period)) runs_sha256 FROM r GROUP BY 1),
    m AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length / period DESC, start, period) = 1),
    x AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) i FROM r),
    c AS (SELECT u.doc_id, string_agg(u.v, ' ' ORDER BY u.i) kept FROM (SELECT doc_id, unnest(w) v, unnest(range(n)) i FROM b JOIN m USING (doc_id)) u ANTI JOIN x USING (doc_id, i) GROUP BY 1)
    SELECT b.doc_id, coalesce(n_runs, 0) n_runs, m.start, m.length, m.period, 1000 * m.length // m.period exponent_milli,
           coalesce(runs_sha256, sha256('')) runs_sha256, sha256(CASE WHEN m.doc_id IS NULL THEN array_to_string(w, ' ') ELSE coalesce(kept, '') END) collapsed_sha256
    FROM b LEFT JOIN t USING (doc_id) LEFT JOIN m ON m.doc_id = b.doc_id LEFT JOIN c ON c.doc_id = b.doc_id
    """,
)
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document, a tenth of which get a periodic end first."""
    found = runs.find_runs(planted_periods(table(spark, sf_dir, "documents").select("doc_id", "text")))
    line = F.transform("periodic.runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    return found.select(
        "doc_id",
        F.size("periodic.runs").cast("long").alias("n_runs"),
        "periodic.top.start",
        "periodic.top.length",
        "periodic.top.period",
        F.expr("periodic.top.length * 1000 div periodic.top.period").alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"),
        F.sha2(F.col("periodic.collapsed_text"), 256).alias("collapsed_sha256"),
    )


@query(
    "op13_repeated_phrases",
    r"""
    WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w FROM documents),
    g AS (SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') g
          FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 12)) i FROM d WHERE len(w) >= 13)),
    f AS (SELECT g, min(doc_id) least FROM g GROUP BY 1 HAVING min(doc_id) < max(doc_id)),
    p AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 12)) k FROM g JOIN f USING (g) WHERE least < doc_id),
    k AS (SELECT u.doc_id, count(*) n, string_agg(u.v, ' ' ORDER BY u.k) kept
          FROM (SELECT doc_id, unnest(w) v, generate_subscripts(w, 1) k FROM d) u ANTI JOIN p USING (doc_id, k) GROUP BY 1)
    SELECT d.doc_id, CAST(len(w) AS BIGINT) n_words, CAST(len(w) - coalesce(k.n, 0) AS BIGINT) n_removed, sha256(coalesce(k.kept, '')) kept_sha256
    FROM d LEFT JOIN k USING (doc_id)
    """,
)
def op13_repeated_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the passages that documents of smaller ids have."""
    found = phrases.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "repeats.n_words", "repeats.n_removed", F.sha2("repeats.kept_text", 256).alias("kept_sha256"))


@query(
    "op11_repair_conversations",
    r"""
    WITH RECURSIVE """
    + _CRC_TABLE
    + """,
    k AS (SELECT conv_id, turn, coalesce(role, ' ') role, coalesce(text, ' ') AS text,
                 """
    + _CRC.format("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")
    + r""" % 20 h FROM conversations, crc),
    d AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END role,
                 CASE h WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
          FROM (SELECT k.*, unnest(CASE h WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) copy FROM k)),
    o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) i FROM d),
    p AS (SELECT *, left(role, 1) r, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) before,
                 CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
                      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                      WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' END fault FROM o),
    e AS (SELECT conv_id, i, 3 c, 'D' a, '' r, '' line FROM p
          UNION ALL SELECT conv_id, i, CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END, 'K', r, chr(10) || role || ':' || text FROM p
          WHERE (fault IS NULL OR fault = 'truncated') AND r IN ('s', 'u', 'a')
          UNION ALL SELECT conv_id, i, CASE WHEN fault = 'truncated' THEN 3 ELSE 2 END, 'R', n[1], chr(10) || n || ':' || text FROM p, (VALUES ('user'), ('assistant')) v(n)
          WHERE (fault IS NULL OR fault = 'truncated') AND n[1] <> r),
    step(q, r, q2) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2), (0, '', 0), (1, '', 1), (2, '', 2), (3, '', 3)),
    u AS (SELECT chr(10) || 'user:' u, chr(10) || 'assistant:' a),
    ins AS (SELECT q, q q2, 0 c, '' a, '' line FROM range(4) t(q)
            UNION ALL SELECT q, q2, 2, 'I', CASE r WHEN 'u' THEN u.u ELSE u.a END FROM step, u WHERE r IN ('u', 'a')
            UNION ALL SELECT x.q, y.q2, 4, 'II', CASE x.r WHEN 'u' THEN u.u || u.a ELSE u.a || u.u END
            FROM step x JOIN step y ON x.q2 = y.q, u WHERE x.r IN ('u', 'a') AND y.r IN ('u', 'a')),
    ids AS (SELECT DISTINCT conv_id FROM conversations),
    f AS (SELECT conv_id, CAST(0 AS BIGINT) i, 0 q, {'c': 0, 'a': '', 'line': ''} v FROM ids
          UNION ALL
          SELECT f.conv_id, e.i, step.q2, min({'c': f.v.c + ins.c + e.c, 'a': f.v.a || ins.a || e.a, 'line': f.v.line || ins.line || e.line})
          FROM f JOIN ins ON ins.q = f.q JOIN e ON e.conv_id IS NOT DISTINCT FROM f.conv_id AND e.i = f.i + 1 JOIN step ON step.q = ins.q2 AND step.r = e.r
          GROUP BY 1, 2, 3),
    z AS (SELECT conv_id, min({'c': f.v.c + ins.c, 'a': f.v.a || ins.a, 'line': f.v.line || ins.line}) v
          FROM f JOIN (SELECT conv_id, max(i) i FROM f GROUP BY 1) m USING (conv_id, i) JOIN ins ON ins.q = f.q WHERE ins.q2 IN (0, 3) GROUP BY 1),
    n AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) gaps, count(*) FILTER (fault = 'blank') blank,
                 count(*) FILTER (fault = 'duplicate') duplicate, count(*) FILTER (fault = 'truncated') truncated,
                 count(*) FILTER (before IS NOT NULL AND before || r NOT IN ('su', 'ua', 'au')) illegal FROM p GROUP BY 1)
    SELECT ids.conv_id, coalesce(gaps, 0) gaps, coalesce(blank, 0) blank, coalesce(duplicate, 0) duplicate, coalesce(truncated, 0) truncated,
           coalesce(illegal, 0) illegal, CAST(z.v.c AS BIGINT) cost, z.v.a audit, sha256(substring(z.v.line, 2)) repaired_sha256
    FROM ids JOIN z ON z.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM ids.conv_id
    """,
)
def op11_repair_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged conversations and their cheapest repair."""
    damaged, copies = repair.damage(table(spark, sf_dir, "conversations"))
    return repair.repair_conversations(damaged, copies=copies)
