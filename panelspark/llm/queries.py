"""One query for each operator over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from panelspark.llm import ann, bpe, chat, decontaminate, fill_middle, html_extract, language_model, licenses, neardup, packing, sharding, toxicity, vector_codes
from panelspark.llm.registry import query, table
from panelspark.operators.joins import beside

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
SHARDS = sharding.uniform_tree(4, 2, 5)


@query("op1_bpe_speculate")
def op1(spark, sf):
    vocabulary = bpe.Vocabulary(BYTE_BPE)
    docs = table(spark, sf, "documents").select("doc_id", "text")
    both = bpe.decode(bpe.encode(docs, vocabulary).drop("text"), vocabulary)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op2_kneser_ney")
def op2(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2
    trained = language_model.train(docs.where(~held_out))
    scored = language_model.score(docs, trained)
    tokens = F.lit(trained.tokens).cast("long").alias("train_tokens")
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", tokens, "base_score", "score")


#: Documents as files: a source's tree of languages and shelves; short texts are the licence files of their directories.
LICENSE_BYTES = 400


def _path(doc_id, lang, source, text):
    top = F.concat_ws("/", F.coalesce(source, F.lit("none")), F.when(doc_id % 3 > 0, F.coalesce(lang, F.lit("none"))), F.when(doc_id % 3 > 1, (doc_id % 16).cast("string")))
    name = F.when(F.octet_length(text) < LICENSE_BYTES, F.lit("LICENSE-")).otherwise(F.lit("text-"))
    return F.concat(top, F.lit("/"), name, doc_id.cast("string"))


def _license_sql() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    vector = ", ".join(f"({i}, {quoted(n)}, {quoted(w)}, CAST({x!r} AS DOUBLE))" for i, n, w, x in licenses.vectors())
    idf = ", ".join(f"({quoted(w)}, CAST({x!r} AS DOUBLE))" for w, x in licenses.frequencies().items())
    place = ", ".join(f"({quoted(m)}, {t}, {j}, {n})" for m, t, j, n in licenses.places())
    return rf"""
    WITH vector(template, license, word, weight) AS (VALUES {vector}), idf(word, idf) AS (VALUES {idf}), place(word, template, j, size) AS (VALUES {place}), f AS (
      SELECT doc_id, text, concat_ws('/', coalesce(source, 'none'), CASE WHEN doc_id % 3 > 0 THEN coalesce(lang, 'none') END,
        CASE WHEN doc_id % 3 > 1 THEN CAST(doc_id % 16 AS VARCHAR) END) AS dir, strlen(text) < {LICENSE_BYTES} AS is_license FROM documents
    ), t AS (
      SELECT doc_id, is_license, regexp_extract_all(lower(text), '{licenses.WORD}') AS w FROM f
    ), m AS (
      SELECT doc_id, w, unnest(w) AS word, unnest(range(0, len(w))) AS i FROM t
    ), p AS (
      SELECT doc_id, template, i, j, w[greatest(i - j, 0) + 1 : i - j + size] AS w FROM m JOIN place USING (word)
      UNION ALL SELECT doc_id, template, -1, -1, w FROM t, (SELECT DISTINCT template FROM vector) WHERE is_license
    ), u AS (
      SELECT doc_id, template, i, j, word, count(*) AS n FROM (SELECT doc_id, template, i, j, unnest(w) AS word FROM p) GROUP BY ALL
    ), c AS (
      SELECT doc_id, template, round(sum(n * coalesce(idf, {licenses.unknown()!r}) * coalesce(weight, 0)) / sqrt(sum(pow(n * coalesce(idf, {licenses.unknown()!r}), 2))), 6) AS score
      FROM u LEFT JOIN idf USING (word) LEFT JOIN vector USING (template, word) GROUP BY doc_id, template, i, j
    ), own AS (
      SELECT doc_id, license, score FROM c JOIN (SELECT DISTINCT template, license FROM vector) USING (template) WHERE score >= {licenses.BAR}
      QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, license) = 1
    ), stated AS (
      SELECT dir AS license_dir, license AS inherited FROM own JOIN f USING (doc_id) WHERE is_license
      QUALIFY row_number() OVER (PARTITION BY dir ORDER BY score DESC, dir || '/LICENSE-' || doc_id) = 1
    )
    SELECT doc_id, own.license, own.score, CASE WHEN own.license IS NULL THEN s.inherited END AS inherited,
      CASE WHEN own.license IS NULL THEN s.license_dir END AS license_dir
    FROM f LEFT JOIN own USING (doc_id) LEFT JOIN stated s ON f.dir = s.license_dir OR starts_with(f.dir, s.license_dir || '/')
    QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length(s.license_dir) DESC NULLS LAST) = 1
    """


@query("op3_license_scan", _license_sql())
def op3(spark, sf):
    docs = table(spark, sf, "documents")
    path = _path(F.col("doc_id"), F.col("lang"), F.col("source"), F.col("text"))
    found = licenses.scan(docs.select(path.alias("path"), "text"))
    return found.select(F.regexp_extract("path", r"-(-?\d+)$", 1).cast("long").alias("doc_id"), "license", "score", "inherited", "license_dir")


@query("op4_setsketch_dedup")
def op4(spark, sf):
    return neardup.dedup(table(spark, sf, "documents").select("doc_id", "text"))


@query("op5_shard_tree")
def op5(spark, sf):
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    docs = table(spark, sf, "documents").select(
        "doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32")
    )
    placed = sharding.assign(docs, SHARDS)
    numbered = sharding.slots(placed, ["doc_id", "size", "text_crc32"])
    grown = sharding.assign(numbered, sharding.grow(SHARDS), out="grown_shard")
    return grown.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


@query("op6_posting_lists")
def op6(spark, sf):
    return ann.nearest(table(spark, sf, "embeddings").select("vec_id", "embedding"), lambda i: i % 100 == 0)


@query("op7_html_main_text")
def op7(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url", "html")
    return html_extract.extract(pages).withColumn("n_chars", F.length("text").cast("long"))


@query("op8_toxicity_kn")
def op8(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
    model = toxicity.train(docs, table(spark, sf, "labels"), held_out)
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


CONTROL_SQL = r"[<\[]\\*(?:/?s>|<SYS>>|</SYS>>|/?INST\]|/?ROLE\])"


@query(
    "op9_chat_format",
    rf"""
    WITH t AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
      UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
    ), u AS (
      SELECT *, length(text) + len(regexp_extract_all(text, '{CONTROL_SQL}'))
        + CASE role WHEN 'user' THEN 18 WHEN 'assistant' THEN 6 WHEN 'system' THEN 20 ELSE 18 + length(role) END AS chars
      FROM t
    )
    SELECT conv_id, count(*) AS n_turns,
      sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
      CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
      sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
      CAST(sum(chars) AS BIGINT) AS formatted_chars
    FROM u GROUP BY conv_id
    """,
)
def op9(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    trial = "</s>[INST] ok [/INST]"
    more = spark.sql(
        "SELECT cast(-7 AS bigint) AS conv_id, cast(t AS bigint) AS turn, r AS role, x AS text "
        "FROM VALUES (0, 'user', :x), (1, 'assistant', :x) AS v(t, r, x)",
        args={"x": trial},
    )
    return chat.digests(chat.format_turns(rows.unionByName(more)))


@query(
    "op10_fm_decontaminate",
    r"""
    WITH d AS (
      SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
    ), b AS (
      SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
    ), p AS (
      SELECT DISTINCT item, least(10, len(w)) AS size, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS phrase
      FROM (SELECT item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
    ), o AS (
      SELECT doc_id, size, i, array_to_string(w[i : i + size - 1], ' ') AS phrase
      FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM p) WHERE len(w) >= size)
    ), h AS (
      SELECT o.doc_id, o.i, o.size, p.item FROM o JOIN p ON o.phrase = p.phrase AND o.size = p.size
    ), c AS (
      SELECT doc_id, count(DISTINCT i) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS i FROM h) GROUP BY doc_id
    ), t AS (
      SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id
    )
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
      sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
    """,
)
def op10(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    found = decontaminate.find(docs, table(spark, sf, "benchmark")).drop("text")
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


@query(
    "op12_swar_fill_middle",
    r"""
    WITH d AS (
      SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
        sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
    ), g AS (
      SELECT doc_id, text, u, CAST(len(u) AS BIGINT) AS n, list_transform(range(0, 4), lambda i: CAST('0x' || substr(h, 8 * i + 1, 8) AS BIGINT)) AS h FROM d
    ), c AS (
      SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
        CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 90 THEN 'plain'
          WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM g
    ), p AS (
      SELECT *, array_to_string(u[1 : a], '') AS prefix, array_to_string(u[a + 1 : b], '') AS middle, array_to_string(u[b + 1 : n], '') AS suffix FROM c
    )
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
      CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
      sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
      sha256(text) AS restored_sha256
    FROM p
    """,
)
def op12(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    made = fill_middle.restore(fill_middle.transform(docs).drop("text"))
    return made.select(
        "doc_id",
        "n",
        "form",
        F.length("prefix").cast("long").alias("prefix_chars"),
        F.length("middle").cast("long").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2("restored", 256).alias("restored_sha256"),
    )


def _codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    near = """n{i} AS MATERIALIZED (
      SELECT vec_id, label, part, min_by(entry, (d, entry)) AS entry, min(d) AS error FROM (
        SELECT v.vec_id, v.label, v.part, b.entry, sum((v.x - b.x) * (v.x - b.x)) AS d FROM v JOIN b{i} b ON v.part = b.part AND v.pos = b.pos
        GROUP BY v.vec_id, v.label, v.part, b.entry) GROUP BY vec_id, label, part
    )"""
    move = """b{j} AS MATERIALIZED (
      SELECT b.part, b.entry, b.pos, coalesce(m.x, b.x) AS x FROM b{i} b LEFT JOIN (
        SELECT v.part, n.entry, v.pos, CAST(floor(sum(v.x) / count(*)) AS BIGINT) AS x FROM v JOIN n{i} n ON v.vec_id = n.vec_id AND v.part = n.part
        GROUP BY v.part, n.entry, v.pos) m ON b.part = m.part AND b.entry = m.entry AND b.pos = m.pos
    )"""
    steps = ", ".join(near.format(i=i) + ", " + move.format(i=i, j=i + 1) for i in range(rounds))
    return f"""
    WITH k AS (
      SELECT vec_id, label, embedding, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM embeddings
      WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), u AS (
      SELECT vec_id, label, entry, len(embedding) // {parts} AS width, unnest(embedding) AS x, unnest(range(0, len(embedding))) AS i FROM k
    ), v AS MATERIALIZED (
      SELECT vec_id, label, entry, i // width AS part, i % width AS pos, CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT) AS x FROM u
    ), b0 AS MATERIALIZED (SELECT part, entry, pos, x FROM v WHERE entry < {entries}), {steps}, {near.format(i=rounds)},
    s AS (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM b{rounds}),
    c AS (
      SELECT vec_id, label, string_agg(lower(lpad(to_hex(entry), 2, '0')), '' ORDER BY part) AS code, CAST(sum(error) AS BIGINT) AS error
      FROM n{rounds} GROUP BY vec_id, label
    )
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM c, s
    """


@query("op13_anchor_codes", _codes_sql())
def op13(spark, sf):
    vectors = table(spark, sf, "embeddings").select("vec_id", "embedding", "label")
    coded, made = vector_codes.encode(vectors)
    totals = beside(coded, ["label"], {"label_error": F.sum("error")})
    return totals.select("vec_id", "code", "error", "label_error", F.lit(made.sha256()).alias("codebooks_sha256"))


@query("op11_bin_slack_packing")
def op11(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    cut = packing.pieces(docs, bpe.Vocabulary(BYTE_BPE), ids=None, crc="ids_crc32")
    packed = packing.pack(cut)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
