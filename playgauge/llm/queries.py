"""The registered query of each operator, by the contract of its result, and the SQL checks."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playgauge.llm import bpe, infill, licences, maxscore, mixing, ngram_join, packing, phrases, pii, simhash, token_rollup, toxicity, urls
from playgauge.llm.common import shared_folder, stored


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.label_spans(docs, pii.fit(docs))
    counts = [F.expr(f"CAST(size(filter(base_spans, x -> x.kind = {k})) AS BIGINT)").alias(f"n_{name}") for k, name in enumerate(pii.KINDS)]
    digest = F.sha2(pii.written("base_spans"), 256).alias("base_sha256")
    return found.select("doc_id", *counts, digest, pii.written("spans").alias("spans"))


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.filtered(pages).select("page_id", "host", "path", "rule", "verdict")


def op4_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return ngram_join.near_duplicates(docs).select("doc_id", "n_shingles", "component_id")


def op6_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", maxscore.scaled().alias("v"))
    return maxscore.top_k(vectors, vectors.where("vec_id % 50 = 0"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As the contract says, and for documents of ids divisible by 20 the number of different fingerprints near theirs."""
    done = stored(simhash.edited_likeness(_table(spark, sf_dir, "documents")), "fingerprints")
    asks = F.coalesce(F.col("doc_id") % 20 == 0, F.lit(False))
    asked = done.where(asks)
    near = simhash.near_counts(asked, done)
    rest = done.where(~asks).withColumn("n_near", F.lit(None).cast("long"))
    return asked.join(near, "fingerprint", "left").unionByName(rest)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after three batches: all documents in; those not in English counted anew; toxic ones out."""
    folder = f"{shared_folder(spark).rstrip('/')}/token-counts-{uuid.uuid4().hex}"
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    docs = stored(token_rollup.ledger(docs, "words-1", "words-2"), "token-ledger")
    toxic = _table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id").distinct()
    foreign = F.coalesce(F.col("lang") != "en", F.lit(True))
    token_rollup.commit(folder, 0, token_rollup.counted(docs, "words-1"))
    again = token_rollup.revised(docs.where(foreign), "words-1", "words-2")
    token_rollup.commit(folder, 1, again)
    out = token_rollup.counted(docs.where(~foreign), "words-1", -1, "doc_id")
    out = out.unionByName(token_rollup.counted(docs.where(foreign), "words-2", -1, "doc_id"))
    out = out.join(toxic, "doc_id")
    token_rollup.commit(folder, 2, out)
    # As a restarted job would: the same batch once more.
    token_rollup.commit(folder, 2, out)
    return token_rollup.totals(spark, folder)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels")
    scored = toxicity.score(docs, toxicity.train(docs, labels))
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = bpe.coded(_table(spark, sf_dir, "documents").select("doc_id", "text"), decoded=True)
    return done.select(
        "doc_id",
        F.expr("CAST(octet_length(ids) DIV 4 AS BIGINT)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op12_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = infill.infilled(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(infill.restored(), 256).alias("restored_sha256"),
    )


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents").select("lang", "text"))


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mixing": op1_mixing,
        "op2_pii": op2_pii,
        "op3_urls": op3_urls,
        "op4_licences": op4_licences,
        "op5_ngram_join": op5_ngram_join,
        "op6_maxscore": op6_maxscore,
        "op7_simhash": op7_simhash,
        "op8_token_counts": op8_token_counts,
        "op9_toxicity": op9_toxicity,
        "op10_packing": op10_packing,
        "op11_bpe": op11_bpe,
        "op12_infill": op12_infill,
        "op13_phrases": op13_phrases,
    }


_OP1 = r"""
WITH s AS (
    SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
           CAST('0x' || substr(md5('7' || coalesce(':' || doc_id::VARCHAR, '')), 1, 15) AS BIGINT) AS mix
    FROM documents
), p AS (
    SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END::DOUBLE AS weight
    FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM s GROUP BY source)
), c AS (
    SELECT *, source_size * 2.0::DOUBLE AS cap, floor(sum(source_size) OVER () * 1.5::DOUBLE) AS budget,
           row_number() OVER w AS pos,
           coalesce(sum(source_size * 2.0::DOUBLE) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
           sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open
    FROM p WINDOW w AS (ORDER BY source_size * 2.0::DOUBLE / weight, source NULLS LAST)
), r AS (
    SELECT *, CASE WHEN (budget - capped) / open * weight <= cap THEN (budget - capped) / open END AS reached FROM c
), t AS (
    SELECT source, source_size, weight, budget,
           CASE WHEN level IS NULL THEN cap ELSE least(cap, level * weight) END AS target
    FROM (SELECT *, (SELECT arg_min(reached, pos) FROM r WHERE reached IS NOT NULL) AS level FROM r)
), u AS (
    SELECT s.*, t.* EXCLUDE (source), sum(size) OVER (PARTITION BY s.source ORDER BY mix, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto
    FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source
), e AS (
    SELECT u.*, epoch, (upto + epoch * source_size)::DOUBLE / weight AS finish FROM u, (VALUES (0), (1)) AS v(epoch)
), f AS (
    SELECT *, sum(size) OVER (ORDER BY finish, mix, doc_id, epoch ROWS UNBOUNDED PRECEDING) AS spent FROM e
)
SELECT doc_id, size, source_size, target,
       CAST(sum(greatest(0, least(size, budget - (spent - size)))) AS BIGINT) AS taken
FROM f GROUP BY doc_id, source, upto, mix, size, source_size, target
"""




def _op3() -> str:
    def hit(term: str) -> str:
        return f"regexp_matches(t, '(^|[^a-z0-9]){term}($|[^a-z0-9])')"

    def fits(rule: str) -> str:
        host, _, path = rule.partition("/")
        return f"((host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}'))"

    by_length = sorted(urls.RULES, key=lambda r: -len(r[0]))
    rules = " ".join(f"WHEN {fits(rule)} THEN '{rule}'" for rule, _ in by_length)
    verdicts = " ".join(f"WHEN '{rule}' THEN '{verdict}'" for rule, verdict in by_length)
    strict = " OR ".join(hit(term) for term in urls.STRICT)
    soft = " + ".join(f"{hit(term)}::INT" for term in urls.SOFT)
    return f"""
WITH r AS (
    SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
    SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{urls.UPPER}', '{urls.LOWER}') AS host,
           regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r
), q AS (
    SELECT *, CASE {rules} END AS rule, translate(host || path, '{urls.UPPER}', '{urls.LOWER}') AS t FROM p
)
SELECT page_id, host, path, rule,
       CASE rule {verdicts} ELSE CASE WHEN {strict} OR {soft} >= 2 THEN 'block' ELSE 'allow' END END AS verdict
FROM q
"""


def _op4() -> str:
    def quoted(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    def form(text: str) -> str:
        out = f"regexp_replace(lower({text}), {quoted(licences.COPYRIGHT_LINE)}, ' ', 'g')"
        for pattern, one in licences.SAME:
            out = f"replace({out}, {quoted(pattern)}, {quoted(one)})"
        return f"trim(regexp_replace({out}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"

    known = ", ".join(f"({quoted(name)}, {quoted(text)})" for name, texts in licences.KNOWN.items() for text in texts)
    return f"""
WITH k AS (
    SELECT DISTINCT licence, sha256({form('t')}) AS digest FROM (VALUES {known}) AS v(licence, t)
), d AS (
    SELECT doc_id, text, string_split(text, chr(10)) AS ls, regexp_split_to_array(text, '\\n[ \\t\\r]*\\n') AS ps
    FROM documents WHERE text IS NOT NULL
), u AS (
    SELECT doc_id, 'text' AS unit, 1 AS number, text AS part FROM d
    UNION ALL SELECT doc_id, 'line', unnest(range(1, len(ls) + 1)), unnest(ls) FROM d WHERE len(ls) > 1
    UNION ALL SELECT * FROM (
        SELECT doc_id, 'paragraph', unnest(range(1, len(ps) + 1)), unnest(ps) AS part FROM d WHERE len(ps) > 1
    ) WHERE contains(part, chr(10))
), c AS (
    SELECT doc_id, unit, number, {form('part')} AS part FROM u
)
SELECT doc_id, unit, CAST(number AS BIGINT) AS number, licence FROM c JOIN k ON sha256(part) = digest WHERE part <> ''
"""


_OP6 = """
WITH e AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT q.vec_id AS query_id, d.vec_id, CAST(list_dot_product(q.v, d.v) AS BIGINT) AS score
    FROM e q JOIN e d ON q.vec_id % 50 = 0 AND q.vec_id <> d.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""

_OP8 = r"""
WITH d AS (
    SELECT source, lang, coalesce(lang <> 'en', true) AS again, text FROM documents
    WHERE doc_id IS NULL OR doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL)
)
SELECT source, lang, CASE WHEN again THEN 'words-2' ELSE 'words-1' END AS version, count(*) AS n_docs,
       CAST(sum(coalesce(len(CASE WHEN again THEN regexp_extract_all(text, '[A-Za-z0-9]+|[^A-Za-z0-9\x20\x09-\x0D]')
                                  ELSE regexp_extract_all(text, '[^\x20\x09-\x0D]+') END), 0)) AS BIGINT) AS n_tokens
FROM d GROUP BY ALL
"""

_OP12 = r"""
WITH t AS (
    SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h,
           regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u
    FROM documents
), d AS (
    SELECT *, CAST(len(u) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
           CAST('0x' || h[17:24] AS BIGINT) % 100 AS h3, CAST('0x' || h[25:32] AS BIGINT) % 100 AS h4
    FROM t
), c AS (
    SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
           CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 >= 50 THEN 'plain'
                WHEN h4 < 80 THEN 'spm' ELSE 'psm' END AS form
    FROM d
), p AS (
    SELECT *, array_to_string(u[1:a], '') AS x, array_to_string(u[a + 1:b], '') AS y, array_to_string(u[b + 1:], '') AS z FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(x) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(y) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y
                        ELSE '<S>' || z || '<P>' || x || '<M>' || y END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""

_OP13 = r"""
WITH p AS (
    SELECT lang, row_number() OVER () AS id, piece
    FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)
), w AS (
    SELECT lang, id, unnest(ws) AS w, unnest(range(len(ws))) AS i
    FROM (SELECT lang, id, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p)
), o AS (
    SELECT lang, w AS w1, lead(w, 1) OVER x AS w2, lead(w, 2) OVER x AS w3, lead(w, 3) OVER x AS w4 FROM w WINDOW x AS (PARTITION BY id ORDER BY i)
), g AS (
    SELECT lang, 1 AS k, w1 AS phrase FROM o
    UNION ALL SELECT lang, 2, w1 || ' ' || w2 FROM o WHERE w2 IS NOT NULL
    UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3 FROM o WHERE w3 IS NOT NULL
    UNION ALL SELECT lang, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 FROM o WHERE w4 IS NOT NULL
), f AS (
    SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30
), c AS (
    SELECT lang, phrase, f AS a, string_split(phrase, ' ') AS ws, k AS size FROM f WHERE k > 1
), t AS (
    SELECT c.*, cut, l.f AS l, r.f AS r,
           CAST(2000000::HUGEINT * a // (l.f + r.f) AS BIGINT) AS score
    FROM c, (VALUES (1), (2), (3)) AS v(cut)
    JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(ws[1:cut], ' ')
    JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(ws[cut + 1:], ' ')
    WHERE cut < size
), s AS (
    SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), x AS (
    SELECT lang, array_to_string(ws[i:j], ' ') AS phrase, max(a) AS around
    FROM c, (VALUES (1, 2), (2, 3), (3, 4), (1, 3), (2, 4)) AS v(i, j) WHERE j <= size AND j - i + 1 < size GROUP BY ALL
), b AS (
    SELECT s.lang, CAST(row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, s.phrase) AS BIGINT) AS rank,
           s.phrase, a, l, r, score
    FROM s LEFT JOIN x ON s.lang = x.lang AND s.phrase = x.phrase WHERE around IS NULL OR 100 * around < 80 * a
)
SELECT b.*, CAST(n AS BIGINT) AS n FROM b JOIN (SELECT lang, count(*) AS n FROM w GROUP BY lang) USING (lang) WHERE rank <= 2000
"""


def statements() -> dict[str, str]:
    return {
        "op1_mixing": _OP1,
        "op3_urls": _op3(),
        "op4_licences": _op4(),
        "op6_maxscore": _OP6,
        "op8_token_counts": _OP8,
        "op12_infill": _OP12,
        "op13_phrases": _OP13,
    }
