"""Queries of this subpackage: one for each operator, over its whole table, and the pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from roamgrid.llm import bpe, collocations, exact_dedup, fill_middle, html_text, language_id, licenses, packing, sharding, simhash, suffix_dedup, toxicity, vector_search

TOKENIZER_FILE = "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes and decodes every document; see bpe.round_trip."""
    import public_tokenizers

    codec = bpe.Codec.from_file(spark, public_tokenizers.path(TOKENIZER_FILE))
    return bpe.round_trip(table(spark, sf_dir, "documents"), codec)


def op2_vector_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five nearest vectors of each query, every fiftieth id, among all others; see vector_search.top_k."""
    vectors = vector_search.integer_vectors(table(spark, sf_dir, "embeddings"))
    return vector_search.top_k(vectors, vectors.where("vec_id % 50 = 0"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences stated in all documents; see licenses.scan."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages by their hosts' winning paths; see html_text.extract."""
    return html_text.extract(table(spark, sf_dir, "pages"))


def op5_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of all documents of up to a mebibyte of text; see sharding.shard_documents."""
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op6_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents; see simhash.near_duplicates."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact duplicates among all documents; see exact_dedup.exact_duplicates."""
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op8_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs all documents by their number of words; see packing.pack."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores all documents with a model fitted on the labelled ones; see toxicity.score."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents by a model fitted on those not held out; see language_id.predict."""
    docs = table(spark, sf_dir, "documents")
    return language_id.predict(docs, language_id.fit(docs))


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated passages of all documents removed; see suffix_dedup.remove_repeats."""
    return suffix_dedup.digests(table(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases of each language of all documents; see collocations.collocations."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fill-in-the-middle of all documents and back; see fill_middle.round_trip."""
    return fill_middle.round_trip(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {
        "op1_bpe_round_trip": op1_bpe_round_trip,
        "op2_vector_top_k": op2_vector_top_k,
        "op3_license_scan": op3_license_scan,
        "op4_html_text": op4_html_text,
        "op5_extendible_shards": op5_extendible_shards,
        "op6_simhash_groups": op6_simhash_groups,
        "op7_exact_dedup": op7_exact_dedup,
        "op8_length_buckets": op8_length_buckets,
        "op9_toxicity": op9_toxicity,
        "op10_language_id": op10_language_id,
        "op11_suffix_dedup": op11_suffix_dedup,
        "op12_collocations": op12_collocations,
        "op13_fill_middle": op13_fill_middle,
        "pipeline": corpus_pipeline.run,
    }


OP2_SQL = """
WITH e AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, max(CAST(list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[]) AS BIGINT)) AS score
           FROM e q JOIN e c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v) GROUP BY ALL)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""


def _license_sql() -> str:
    """The scan in DuckDB's SQL: sentences by marks, a table of the known ones, and the rules in turn."""
    known = ", ".join(f"('{sentence}', '{name}')" for some in (licenses.SENTENCES, licenses.MORE_SENTENCES) for name, sentences in some.items() for sentence in sentences)
    rules, names, last = "", {}, "joined"
    for number, (name, sequence) in enumerate(licenses.MORE_RULES + licenses.RULES):
        pattern = "".join(f",{x}," for x in sequence)
        rules += f", s{number} AS (SELECT *, contains(rest, '{pattern}') AS rule_{number} FROM (SELECT * FROM {last})), t{number} AS (SELECT * REPLACE (replace(rest, '{pattern}', '|') AS rest) FROM s{number})"
        names.setdefault(name, []).append(f"rule_{number}")
        last = f"t{number}"
    found = ", ".join(f"CASE WHEN {' OR '.join(columns)} THEN '{name}' END" for name, columns in names.items())
    return rf"""
WITH known(sentence, id) AS (VALUES {known}),
numbered AS (SELECT *, row_number() OVER () AS row FROM documents),
pieces AS (SELECT row, unnest(regexp_split_to_array(regexp_replace(coalesce(text, ''), '[.;:!?](\s|$)', E'\n\\1', 'g'), '[\n\r]+')) AS piece,
                  generate_subscripts(regexp_split_to_array(regexp_replace(coalesce(text, ''), '[.;:!?](\s|$)', E'\n\\1', 'g'), '[\n\r]+'), 1) AS place FROM numbered),
plain AS (SELECT row, place, trim(regexp_replace(lower(piece), '[^a-z0-9]+', ' ', 'g')) AS sentence FROM pieces),
hits AS (SELECT row, list(id ORDER BY place) AS ids FROM plain JOIN known USING (sentence) GROUP BY row),
joined AS (SELECT doc_id, coalesce(ids, []) AS ids, coalesce(',' || array_to_string(ids, ',,') || ',', '') AS rest FROM numbered LEFT JOIN hits USING (row)){rules}
SELECT doc_id, array_to_string(ids, ',') AS sentence_ids, concat_ws(',', {found}) AS licenses,
       CAST(len(list_filter(regexp_split_to_array(rest, '[,|]+'), lambda x: x <> '')) AS BIGINT) AS unmatched
FROM {last}
"""


_BITS = "translate(left(md5({}), 16), '0123456789abcdef', 'ghijklmnopqrstuv')"
for _digit in range(16):
    _BITS = f"replace({_BITS}, '{'ghijklmnopqrstuv'[_digit]}', '{_digit:04b}')"
OP5_SQL = f"""
WITH r AS (SELECT doc_id, row_number() OVER () AS row, strlen(coalesce(text, '')) AS bytes,
                  {_BITS.format("coalesce(CAST(doc_id AS VARCHAR), '')")} || {_BITS.format("coalesce(text, '')")} AS bits FROM documents),
     d AS (SELECT r.*, depth, left(bits, depth) AS prefix FROM r, (SELECT unnest(range(0, 129)) AS depth)),
     s AS (SELECT *, sum(bytes) OVER (PARTITION BY prefix) AS total FROM d),
     f AS (SELECT row, doc_id, bytes, bits, min(depth) AS depth, min_by(total, depth) AS shard_bytes FROM s WHERE total <= {sharding.LIMIT_BYTES} OR depth = 128 GROUP BY ALL)
SELECT doc_id, bytes, CASE WHEN depth = 0 THEN '~' ELSE left(bits, depth) END AS shard, CAST(shard_bytes AS BIGINT) AS shard_bytes FROM f
"""
OP7_SQL = r"""
WITH n AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
     d AS (SELECT doc_id, length(t) AS n, sha256(translate(t, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS h FROM n)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY h) AS group_size,
       row_number() OVER w = 1 AS kept,
       h AS text_sha256
FROM d WINDOW w AS (PARTITION BY h ORDER BY n DESC, doc_id)
"""
OP12_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0B\f\r]')) AS piece FROM documents),
     w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS words FROM p),
     g AS (SELECT lang, words[i:i + s - 1] AS gram FROM (SELECT lang, words, s, unnest(range(1, len(words) - s + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS s))),
     c AS (SELECT lang, gram, count(*) AS f FROM g GROUP BY ALL),
     n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM c WHERE len(gram) = 1 GROUP BY lang),
     k AS (SELECT lang, gram, f AS a FROM c WHERE len(gram) > 1 AND f >= 30),
     cut AS (SELECT lang, gram, a, unnest(range(1, len(gram))) AS cutting FROM k),
     s AS (SELECT cut.*, x.f AS l, y.f AS r, CAST((2000000::HUGEINT * a) // (x.f + y.f) AS BIGINT) AS score FROM cut
           JOIN c x ON x.lang = cut.lang AND x.gram = cut.gram[1:cutting] JOIN c y ON y.lang = cut.lang AND y.gram = cut.gram[cutting + 1:len(cut.gram)]),
     b AS (SELECT lang, gram, a, arg_min(l, (score, cutting)) AS l, arg_min(r, (score, cutting)) AS r, min(score) AS score FROM s GROUP BY ALL),
     i AS (SELECT lang, gram[i:i + s - 1] AS gram, a AS longer FROM (SELECT lang, gram, a, s, unnest(range(1, len(gram) - s + 2)) AS i FROM k, (SELECT unnest([2, 3]) AS s) WHERE s < len(gram))),
     h AS (SELECT lang, gram, max(longer) AS longer FROM i GROUP BY ALL),
     o AS (SELECT b.* FROM b LEFT JOIN h USING (lang, gram) WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a),
     t AS (SELECT lang, array_to_string(gram, ' ') AS phrase, a, l, r, score FROM o)
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM t) JOIN n USING (lang) WHERE rank <= 2000
"""
OP13_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
     g AS (SELECT *, length(t) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
                  CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d),
     f AS (SELECT *, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
                  least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM g),
     p AS (SELECT *, substring(t, 1, a) AS prefix, substring(t, a + 1, b - a) AS middle, substring(t, b + 1, n - b) AS suffix FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""


def oracle_sql() -> dict[str, str]:
    found = {"op2_vector_top_k": OP2_SQL, "op3_license_scan": _license_sql(), "op5_extendible_shards": OP5_SQL, "op7_exact_dedup": OP7_SQL, "op12_collocations": OP12_SQL, "op13_fill_middle": OP13_SQL}
    return found | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
