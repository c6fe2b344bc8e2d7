"""One query for each operator, applied with production parameters to its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import chat, decontaminate, exact, lines, packing, quality, resample, secrets, shared, simhash, substrings, toxicity, trie, warc


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op8_toxicity(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return toxicity.classify(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def op9_line_dedup(spark, sf_dir):
    found = lines.dedup_lines(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_deleted", F.sha2("text", 256).alias("text_sha256"))


def op10_warc(spark, sf_dir):
    records = warc.round_trip(_table(spark, sf_dir, "pages"), payload=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


def op1_decontaminate(spark, sf_dir):
    found = decontaminate.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def pieces_of(docs):
    import public_tokenizers

    tokens = packing.tokenized(docs, 1024, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return packing.pack(tokens, 1024).drop("part", "row")


def op2_packing(spark, sf_dir):
    return pieces_of(_table(spark, sf_dir, "documents"))


def op3_chat(spark, sf_dir):
    rows = chat.rotate(_table(spark, sf_dir, "conversations"))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s.start.cast("string"), s.stop.cast("string"))), ",")
    return rows.select("conv_id", "perspective", "chunk", F.size("messages").cast("long").alias("n_turns"), "text", spans.alias("mask_spans"))


def op4_exact_dedup(spark, sf_dir):
    return exact.dedup(_table(spark, sf_dir, "documents")).drop("_h")


def op5_quality(spark, sf_dir):
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_simhash(spark, sf_dir):
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_secrets(spark, sf_dir):
    """Half of the documents come to the ledger under the base rules, then all of them under both rule versions, of which each blob lacks one or two."""
    docs, ledger = _table(spark, sf_dir, "documents"), shared.new_path(spark, "secret-ledger")
    first = lambda c: F.coalesce(F.crc32(F.col(c).cast("string").cast("binary")) % 2, F.lit(0)) == 0
    addressed = secrets.versions(docs)
    secrets.update(docs.where(first("doc_id")), ledger, ["base-1"], addressed=addressed.where(first("path")))
    secrets.update(docs, ledger, ["base-1", "more-1"], addressed=addressed)
    found = secrets.findings(addressed, ledger, "more-1")
    return found.select(F.col("path").alias("doc_id"), "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "blob")


def op11_substring_dedup(spark, sf_dir):
    found = substrings.dedup_substrings(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op12_importance_resampling(spark, sf_dir):
    found = resample.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def op13_conversation_trie(spark, sf_dir):
    """The trie of the rebuilt conversations: each begins with some turns of the one whose id is the multiple of 20 before."""
    return trie.prefix_trie(*trie.spliced(trie.numbered(_table(spark, sf_dir, "conversations"))))


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_packing": op2_packing,
    "op3_chat": op3_chat,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_quality": op5_quality,
    "op6_simhash": op6_simhash,
    "op7_secrets": op7_secrets,
    "op8_toxicity": op8_toxicity,
    "op9_line_dedup": op9_line_dedup,
    "op10_warc": op10_warc,
    "op11_substring_dedup": op11_substring_dedup,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_conversation_trie": op13_conversation_trie,
}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')"

ORACLE_SQL = {
    "op1_decontaminate": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
item_windows AS (SELECT DISTINCT item_id, list_slice(w, i, i + least(10, len(w)) - 1) AS win
                 FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT len(win) AS n FROM item_windows),
doc_windows AS (SELECT doc_id, i, n, list_slice(w, i, i + n - 1) AS win
                FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lengths WHERE len(w) >= n)),
occurs AS (SELECT doc_id, i, n, item_id FROM doc_windows JOIN item_windows USING (win)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM occurs)) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM occurs) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)""",
    "op3_chat": """
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(nullif(trim(role), ''), 'unknown') AS speaker, replace(coalesce(text, ''), '<|', '< |') AS content FROM conversations),
a AS (SELECT *, CASE WHEN conv_id IS NULL THEN row_number() OVER () ELSE 0 END AS apart FROM t),
c AS (SELECT *, (row_number() OVER (PARTITION BY conv_id, apart ORDER BY turn NULLS FIRST, speaker, content) - 1) // 1024 AS chunk, lower(speaker) = 'system' AS is_system FROM a),
p AS (SELECT DISTINCT conv_id, apart, speaker AS perspective FROM c WHERE NOT is_system),
m AS (SELECT c.*, perspective, NOT is_system AND speaker = perspective AS own,
             '<|' || CASE WHEN is_system THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user name=' || replace(replace(replace(replace(replace(replace(speaker, '%', '%25'), '<', '%3C'), '>', '%3E'), '|', '%7C'), chr(10), '%0A'), chr(13), '%0D') END || '|>' || chr(10) AS head
      FROM c JOIN p ON c.conv_id IS NOT DISTINCT FROM p.conv_id AND c.apart = p.apart),
o AS (SELECT *, coalesce(sum(length(head) + length(content) + 8) OVER (PARTITION BY conv_id, apart, perspective, chunk ORDER BY turn NULLS FIRST, speaker, content ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS start FROM m)
SELECT conv_id, perspective, chunk, count(*) AS n_turns,
       string_agg(head || content || '<|end|>' || chr(10), '' ORDER BY turn NULLS FIRST, speaker, content) AS text,
       coalesce(string_agg(CAST(start AS BIGINT) || ':' || CAST(start + length(content) AS BIGINT), ',' ORDER BY turn NULLS FIRST, speaker, content) FILTER (WHERE own), '') AS mask_spans
FROM o GROUP BY conv_id, apart, perspective, chunk""",
    "op4_exact_dedup": """
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n_points, sha256(translate(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS text_sha256 FROM documents),
g AS (SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d
      WINDOW w AS (PARTITION BY text_sha256 ORDER BY n_points DESC, doc_id))
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g""",
    "op9_line_dedup": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, CASE WHEN coalesce(text, '') = '' THEN [] ELSE string_split(text, chr(10)) END AS all_lines FROM documents),
l AS (SELECT doc_id, i AS line, regexp_replace(all_lines[i], '^[ \t-\r]+|[ \t-\r]+$', '', 'g') AS body FROM d, unnest(range(1, len(all_lines) + 1)) AS u(i)),
n AS (SELECT *, len(regexp_extract_all(body, '[^ \t-\r]+')) AS words, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS pos FROM l WHERE body <> ''),
s AS (SELECT *, sum(words) OVER (PARTITION BY doc_id ORDER BY pos) AS total FROM n),
w AS (SELECT a.doc_id, a.pos AS first, min(b.pos) AS last FROM s a JOIN s b ON a.doc_id = b.doc_id AND b.pos >= a.pos AND b.total - a.total + a.words >= 50 GROUP BY 1, 2
      UNION
      SELECT b.doc_id, max(a.pos) AS first, b.pos AS last FROM s a JOIN s b ON a.doc_id = b.doc_id AND b.pos >= a.pos AND b.total - a.total + a.words >= 50 GROUP BY 1, 3),
k AS (SELECT w.doc_id, first, last, string_agg(body, chr(10) ORDER BY pos) AS content FROM w JOIN s ON s.doc_id = w.doc_id AND s.pos BETWEEN first AND last GROUP BY 1, 2, 3),
f AS (SELECT *, first_value(doc_id) OVER copies AS in_doc, first_value(last) OVER copies AS until FROM k WINDOW copies AS (PARTITION BY content ORDER BY doc_id, first)),
later AS (SELECT * FROM f WHERE in_doc <> doc_id OR until < first),
gone AS (SELECT DISTINCT s.doc_id, s.line FROM later JOIN s ON s.doc_id = later.doc_id AND s.pos BETWEEN first AND last)
SELECT d.doc_id, len(all_lines) AS n_lines, count(gone.line) AS n_deleted,
       sha256(coalesce(string_agg(all_lines[i], chr(10) ORDER BY i) FILTER (WHERE gone.line IS NULL), '')) AS text_sha256
FROM d LEFT JOIN LATERAL (SELECT unnest(range(1, len(d.all_lines) + 1)) AS i) ON true LEFT JOIN gone ON gone.doc_id = d.doc_id AND gone.line = i
GROUP BY d.doc_id, d.all_lines""",
    "op10_warc": """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, url, strlen(html) AS payload_bytes, sha256(html) AS payload_digest FROM p),
g AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to, url
FROM g""",
    "op11_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
f AS (SELECT k, min(doc_id) AS first FROM win GROUP BY k),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT win.doc_id, unnest(range(i, i + 13)) AS p FROM win JOIN f USING (k) WHERE first < win.doc_id)),
each AS (SELECT doc_id, w[j] AS word, j FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS j FROM d))
SELECT d.doc_id, len(w) AS n_words, count(gone.p) AS n_removed,
       sha256(coalesce(string_agg(word, ' ' ORDER BY j) FILTER (WHERE gone.p IS NULL), '')) AS kept_sha256
FROM d LEFT JOIN each USING (doc_id) LEFT JOIN gone ON gone.doc_id = d.doc_id AND gone.p = each.j
GROUP BY d.doc_id, len(w)""",
}
