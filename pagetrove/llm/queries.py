"""Registered queries of the training-data operators."""

import public_tokenizers
from pyspark.sql import functions as F

from . import (
    bpe, chat, licences, negatives, neighbours, packing, quality, ranking, secrets, sharding, simhash, substrings, warc,
)

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"

COSINE = 0.98
SHARDS = 24
SHINGLE, RADIUS = 3, 2


def _documents(spark, sf_dir, *columns):
    return spark.read.schema(DOCUMENTS).parquet(f"{sf_dir}/documents.parquet").select(*columns or "*")


def op1_warc(spark, sf_dir):
    pages = spark.read.schema("page_id long, url string, html string").parquet(f"{sf_dir}/pages.parquet")
    return warc.roundtrip(pages)


def op2_bpe(spark, sf_dir):
    docs = _documents(spark, sf_dir, "doc_id", "text")
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.digest(docs, path, public_tokenizers.PATTERN, ["doc_id"])


def op3_substrings(spark, sf_dir):
    return substrings.digest(_documents(spark, sf_dir, "doc_id", "text"))


def op4_embeddings(spark, sf_dir):
    schema = "vec_id long, embedding array<float>, label int"
    return neighbours.cluster(spark.read.schema(schema).parquet(f"{sf_dir}/embeddings.parquet"), COSINE).rows


def op5_simhash(spark, sf_dir):
    found = simhash.cluster(_documents(spark, sf_dir, "doc_id", "text"), SHINGLE, RADIUS)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_quality(spark, sf_dir):
    measured = quality.measure(_documents(spark, sf_dir, "doc_id", "text"), "doc_id")
    return quality.verdict(measured).select("doc_id", *quality.BASE, "base_failed", "kept")


def op7_packing(spark, sf_dir):
    docs = _documents(spark, sf_dir, "doc_id", "text")
    packed = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op8_sharding(spark, sf_dir):
    placed = sharding.shard(_documents(spark, sf_dir, "doc_id", "text"), SHARDS)
    return placed.select(
        "doc_id", "size", F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def op9_licences(spark, sf_dir):
    return licences.scan(_documents(spark, sf_dir, "doc_id", "text"))


def op10_secrets(spark, sf_dir):
    docs = _documents(spark, sf_dir, "doc_id", "text", "lang", "source")
    found = secrets.scan(docs, owner="source", repository="lang", keep=["doc_id"])

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("spans", lambda s: s["kind"].isin(*secrets.BASE_KINDS))

    def number(kind):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long")

    counts = [
        number(kind).alias(f"n_{kind}") for kind in secrets.BASE_KINDS
    ]
    return found.select(
        "doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: ~s["copied"])).cast("long").alias("n_owned"),
        F.size(F.filter("spans", lambda s: s["copied"])).cast("long").alias("n_copied"),
    )


def op11_negatives(spark, sf_dir):
    schema = "vec_id long, embedding array<float>, label int"
    rows = spark.read.schema(schema).parquet(f"{sf_dir}/embeddings.parquet")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)


def op12_chat(spark, sf_dir):
    schema = "conv_id long, turn long, role string, text string"
    turns = spark.read.schema(schema).parquet(f"{sf_dir}/conversations.parquet")
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], schema)
    # The extra conversation stays apart from any that has its id.
    every = turns.withColumn("_probe", F.lit(False)).unionByName(probe.withColumn("_probe", F.lit(True)))
    keys = ("conv_id", "_probe")
    return chat.read_back(chat.format_chats(every, keys=keys), keys, in_order=True).drop("_probe")


def op13_ranking(spark, sf_dir):
    items = spark.read.schema("item_id long, text string").parquet(f"{sf_dir}/benchmark.parquet")
    return ranking.rank(_documents(spark, sf_dir, "doc_id", "text"), items)


LLM_QUERIES = {
    f.__name__: f
    for f in (
        op1_warc, op2_bpe, op3_substrings, op4_embeddings, op5_simhash, op6_quality, op7_packing, op8_sharding,
        op9_licences, op10_secrets, op11_negatives, op12_chat, op13_ranking,
    )
}
LLM_ORACLES = {
    "op1_warc": """
        WITH p AS (
            SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
        ), d AS (
            SELECT page_id, octet_length(payload) AS n, sha256(payload) AS digest FROM p
        ), f AS (
            SELECT *, min(page_id) OVER (PARTITION BY digest) AS first FROM d
        )
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
            CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
        FROM f
    """,
    "op3_substrings": r"""
        WITH w AS (
            SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
            FROM documents
        ), places AS (
            SELECT doc_id, words, unnest(range(greatest(len(words) - 49, 0))) AS p FROM w
        ), windows AS (
            SELECT doc_id, p, array_to_string(words[p + 1 : p + 50], ' ') AS gram FROM places
        ), hit AS (
            SELECT doc_id, p FROM windows QUALIFY min(doc_id) OVER (PARTITION BY gram) < doc_id
        ), gone AS (
            SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS p FROM hit
        ), each AS (
            SELECT doc_id, list(p) AS gone FROM gone GROUP BY doc_id
        )
        SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
            sha256(array_to_string(CASE WHEN gone IS NULL THEN words ELSE
                list_filter(words, lambda x, i: NOT list_contains(gone, i - 1)) END, ' ')) AS kept_sha256
        FROM w LEFT JOIN each USING (doc_id)
    """,
    "op4_embeddings": f"""
        WITH RECURSIVE v AS (
            SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
            WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), links AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
            ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= {COSINE}
        ), reach(a, b) AS (
            SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
        ), least AS (
            SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a
        )
        SELECT vec_id, (SELECT count(*) FROM links WHERE links.a = least.vec_id)::BIGINT AS n_links, component_id,
            vec_id = component_id AS kept
        FROM least
    """,
}


LLM_ORACLES["op11_negatives"] = """
    WITH v AS (
        SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
            list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
        FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), scored AS (
        SELECT a.vec_id AS anchor_id, v.vec_id, a.label = v.label AS same, list_dot_product(a.e, v.e)::BIGINT AS score
        FROM v a JOIN v ON len(a.e) = len(v.e) WHERE a.vec_id % 100 = 0
    ), positives AS (
        SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same AND vec_id <> anchor_id
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
    )
    SELECT anchor_id, positive_id,
        (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id))::INT AS rank,
        vec_id AS negative_id, positive_score, score AS negative_score
    FROM positives JOIN scored USING (anchor_id)
    WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score QUALIFY rank <= 10
"""


def _quality_sql() -> str:
    stops = "|".join(quality.STOP_WORDS)
    rules = [
        f"coalesce({rule.part}::DOUBLE / nullif({rule.whole}, 0) {sign} {bound}, true)"
        for rule in quality.RULES for sign, bound in ((">=", rule.low), ("<=", rule.high)) if bound is not None
    ]
    return rf"""
        WITH d AS (
            SELECT doc_id, coalesce(text, '') AS text,
                list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
                list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
            FROM documents
        ), places AS (
            SELECT doc_id, words, unnest(range(greatest(len(words) - 2, 0))) AS p FROM d
        ), grams AS (
            SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, words[p + 1], words[p + 2], words[p + 3]) AS n FROM places
        ), covered AS (
            SELECT DISTINCT doc_id, unnest([p, p + 1, p + 2]) AS p FROM grams WHERE n > 1
        ), repeats AS (
            SELECT doc_id, count(*) AS n_repeat_words FROM covered GROUP BY doc_id
        ), m AS (
            SELECT d.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
                length(regexp_replace(text, '[^{quality.SYMBOLS}]+', '', 'g'))::BIGINT AS n_symbols,
                (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
                coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines,
                len(list_filter(words, lambda x, i: regexp_matches(x, '^(?:{stops})(?:$|[.,;:!?])')
                    AND (i > 1 OR regexp_matches(text, '^[\x20\x09-\x0D]'))
                    AND (i < len(words) OR regexp_matches(text, '[\x20\x09-\x0D]$')
                        OR regexp_matches(x, '[.,;:!?]')))) AS n_stop_words,
                len(regexp_extract_all(text, '[.!?:;…"”»)。][\x20\x09\x0B-\x0D]*(?:\n|\z)')) AS n_end_marks,
                length(regexp_replace(text, '\P{{Lu}}+', '', 'g')) AS n_capitals,
                length(regexp_replace(text, '\P{{L}}+', '', 'g')) AS n_letters
            FROM d LEFT JOIN repeats USING (doc_id)
        ), f AS (
            SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
        )
        SELECT doc_id, {", ".join(quality.BASE)}, base_failed, NOT base_failed AND {" AND ".join(rules)} AS kept FROM f
    """


def _secrets_sql() -> str:
    """Runs of a least length replace the filter on length where both find the same."""
    words = ["password", "passwd", "secret", "token", "api_?key"]
    keys = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in words)
    patterns = {
        "assign": (f"(?:{keys})[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)", 1, "length(value) >= 8"),
        "access": ("AKIA[A-Z0-9]{12,}", 0, "true"),
        "hex": ("[0-9a-f]{32,}", 0, "true"),
    }
    mixed = (
        "regexp_matches(value, '[0-9]') AND regexp_matches(value, '[a-z]') AND regexp_matches(value, '[A-Z]') "
        f"AND len(list_distinct(string_split(value, ''))) >= {secrets.MIN_DISTINCT}"
    )
    patterns |= {
        kind: (pattern, 0, f"length(value) >= {least} AND {mixed}") for kind, (pattern, _, least) in secrets.METHOD.items()
    }
    found = " UNION ALL ".join(
        f"""
            SELECT doc_id, source, first AS start, {rank} AS rank, first + length(every[i]) AS stop, '{kind}' AS kind, value
            FROM (
                SELECT *, vals[i] AS value,
                    list_sum(list_transform(gaps[1:i], lambda x: length(x)))
                    + coalesce(list_sum(list_transform(every[1:i - 1], lambda x: length(x))), 0) AS first
                FROM (
                    SELECT *, unnest(range(1, len(every) + 1)) AS i FROM (
                        SELECT doc_id, source, string_split_regex(text, '{pattern}') AS gaps,
                            regexp_extract_all(text, '{pattern}', 0) AS every,
                            regexp_extract_all(text, '{pattern}', {group}) AS vals
                        FROM documents WHERE regexp_matches(text, '{pattern}')
                    )
                )
            ) WHERE {keep}
        """
        for rank, (kind, (pattern, group, keep)) in enumerate(patterns.items())
    )
    line = "string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, rank, stop)"
    base = "kind IN ('assign', 'access', 'hex')"
    return f"""
        WITH found AS ({found}), owners AS (
            SELECT value, count(DISTINCT source) >= {secrets.COPIED_OWNERS} AS copied FROM found GROUP BY value
        ), judged AS (
            SELECT * FROM found JOIN owners USING (value) WHERE {base} OR NOT copied
        ), each AS (
            SELECT doc_id, {line} AS spans, {line} FILTER (WHERE {base}) AS base,
                {", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in secrets.BASE_KINDS)},
                count(*) FILTER (WHERE NOT copied) AS n_owned, count(*) FILTER (WHERE copied) AS n_copied
            FROM judged GROUP BY doc_id
        )
        SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in (*secrets.BASE_KINDS, "owned", "copied"))},
            sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM documents LEFT JOIN each USING (doc_id)
    """


def _ranking_sql() -> str:
    terms = f"regexp_extract_all(translate(coalesce(text, ''), '{ranking.UPPER}', '{ranking.LOWER}'), '{ranking.TERM}')"
    return f"""
        WITH d AS (
            SELECT doc_id, {terms} AS terms FROM documents
        ), totals AS (
            SELECT count(*) FILTER (WHERE len(terms) > 0) AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM d
        ), wanted AS (
            SELECT DISTINCT item_id, unnest({terms}) AS term FROM benchmark
        ), tf AS (
            SELECT doc_id, len(terms) AS n, term, count(*) AS tf
            FROM (SELECT doc_id, terms, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM wanted)
            GROUP BY ALL
        ), weights AS (
            SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w
            FROM tf, totals GROUP BY term
        ), gains AS (
            SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms))) AS gain
            FROM tf JOIN weights USING (term), totals
        ), scores AS (
            SELECT item_id, doc_id, sum(gain)::BIGINT AS score FROM wanted JOIN gains USING (term) GROUP BY ALL
        )
        SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score
        FROM scores WHERE score > 0 QUALIFY rank <= 50
    """


def _chat_sql() -> str:
    """The masked length without masking: one character more for each control string, masked before or not."""
    said = "</s>[INST] ok [/INST]"

    def masked(column):
        return rf"length({column}) + len(regexp_extract_all({column}, '<\\*/?s>|\[\\*(?:/?INST|/?ROLE|TEXT)\]'))"

    order = "ORDER BY turn NULLS FIRST, role, text"
    return rf"""
        WITH t AS (
            SELECT conv_id, false AS probe, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL VALUES (-1, true, 0, 'user', '{said}'), (-1, true, 1, 'assistant', '{said}')
        )
        SELECT conv_id, count(*)::BIGINT AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' {order})) AS turns_sha256,
            coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
            sha256(coalesce(string_agg(text, '' {order}) FILTER (role = 'assistant'), '')) AS loss_sha256,
            sum(CASE role WHEN 'user' THEN length('<s>[INST]  [/INST]') WHEN 'assistant' THEN length('</s>')
                ELSE length('<s>[ROLE][TEXT][/ROLE]') + {masked("role")} END + {masked("text")})::BIGINT AS formatted_chars
        FROM t GROUP BY conv_id, probe
    """


LLM_ORACLES["op6_quality"] = _quality_sql()
LLM_ORACLES["op12_chat"] = _chat_sql()
LLM_ORACLES["op13_ranking"] = _ranking_sql()
LLM_ORACLES["op10_secrets"] = _secrets_sql()
