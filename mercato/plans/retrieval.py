"""Knowledge retrieval: BM25, cosine similarity, reciprocal rank fusion, contamination."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..sources.tables import read
from .registry import query

r4 = lambda c: F.round(c + 1e-9, 4)
TERMS = ("the", "of", "thing", "that", "ering")
_T = ", ".join(f"('{t}')" for t in TERMS)
BM25 = f"""WITH tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM documents), dl AS (SELECT doc_id, count(*) AS len FROM tok GROUP BY doc_id), st AS (SELECT count(*) AS n, avg(len) AS avg_len FROM dl),
    tf AS (SELECT doc_id, t, count(*) AS tf FROM tok WHERE t IN (SELECT * FROM (VALUES {_T})) GROUP BY ALL), df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
    sc AS (SELECT tf.doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avg_len))) AS score FROM tf JOIN df USING (t) JOIN dl ON dl.doc_id = tf.doc_id CROSS JOIN st GROUP BY tf.doc_id)"""


def bm25_scores(spark, sf_dir, terms=TERMS, k1=1.5, b=0.75):
    """BM25 of a query over all documents. Only the query's terms are exploded; lengths come from the token count, not from rows."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]+)"), 1).alias("tok"))
    d = d.where(F.size("tok") > 0).select("doc_id", F.size("tok").alias("len"), F.filter("tok", lambda t: t.isin(*terms)).alias("hits"))
    stats = F.broadcast(d.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len")))
    tf = d.select("doc_id", "len", F.explode("hits").alias("t")).groupBy("doc_id", "len", "t").agg(F.count("*").alias("tf"))
    df = F.broadcast(tf.groupBy("t").agg(F.count("*").alias("df")))  # a row for each query term
    idf = F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * ((1 - b) + b * F.col("len") / F.col("avg_len")))
    return tf.join(df, "t").crossJoin(stats).groupBy("doc_id").agg(F.sum(part).alias("score"))


@query(BM25 + " SELECT doc_id, round(score + 1e-9, 4) AS score FROM sc")
def bm25(spark, sf_dir):
    return bm25_scores(spark, sf_dir).select("doc_id", r4(F.col("score")).alias("score"))


COS = """WITH q AS (SELECT embedding AS qe FROM embeddings WHERE vec_id = 0), c AS (SELECT vec_id, list_sum(list_transform(list_zip(embedding, qe), lambda x: CAST(x[1] AS DOUBLE) * CAST(x[2] AS DOUBLE))) / nullif(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)) * list_sum(list_transform(qe, lambda x: CAST(x AS DOUBLE) * x))), 0) AS sim FROM embeddings, q WHERE len(embedding) = len(qe))"""


def cosines(spark, sf_dir, query_id=0):
    """Cosine of every vector with one query vector; other lengths are left out, not scored as zero."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    q = F.broadcast(e.where(F.col("vec_id") == query_id).select(F.col("e").alias("q")))  # one vector
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return e.crossJoin(q).where(F.size("e") == F.size("q")).select("vec_id", F.try_divide(dot("e", "q"), F.sqrt(dot("e", "e") * dot("q", "q"))).alias("sim"))


@query(COS + " SELECT vec_id, round(sim + 1e-9, 4) AS sim FROM c")
def cosine(spark, sf_dir):
    return cosines(spark, sf_dir).select("vec_id", r4(F.col("sim")).alias("sim"))


@query(COS + " SELECT vec_id, round(sim + 1e-9, 4) AS sim FROM c WHERE vec_id <> 0 ORDER BY round(sim, 6) DESC, vec_id LIMIT 20")
def cosine_topk(spark, sf_dir, k=20):
    return cosines(spark, sf_dir).where("vec_id <> 0").orderBy(F.desc(F.round("sim", 6)), "vec_id").limit(k).select("vec_id", r4(F.col("sim")).alias("sim"))


@query(BM25 + ", " + COS[5:] + """, a AS (SELECT doc_id AS id, row_number() OVER (ORDER BY round(score, 6) DESC, doc_id) AS r FROM sc), b AS (SELECT vec_id AS id, row_number() OVER (ORDER BY round(sim, 6) DESC, vec_id) AS r FROM c),
    u AS (SELECT * FROM a WHERE r <= 60 UNION ALL SELECT * FROM b WHERE r <= 60) SELECT id, round(sum(1.0 / (60 + r)), 6) AS rrf FROM u GROUP BY id""")
def rrf(spark, sf_dir, k=20):
    """Reciprocal rank fusion of the two lists' top 3k, which are cut by top-k before they are ranked."""
    def ranked(df, id_, score):
        top = df.orderBy(F.desc(F.round(score, 6)), id_).limit(3 * k)
        return top.select(F.col(id_).alias("id"), F.row_number().over(Window.orderBy(F.desc(F.round(score, 6)), id_)).alias("r"))

    both = ranked(bm25_scores(spark, sf_dir), "doc_id", "score").unionByName(ranked(cosines(spark, sf_dir), "vec_id", "sim"))
    return both.groupBy("id").agg(F.round(F.sum(1.0 / (60 + F.col("r"))), 6).alias("rrf"))


@query("""SELECT doc_id, lang, length(text) AS n_chars, regexp_matches(lower(text), '\\b(license|licensed)\\b') AS has_license FROM documents""")
def license_lines(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", "lang", F.length("text").alias("n_chars"), F.lower("text").rlike(r"\b(license|licensed)\b").alias("has_license"))


@query("""WITH s AS (SELECT doc_id, CAST(generate_subscripts(parts, 1) - 1 AS INTEGER) AS section, unnest(parts) AS body FROM (SELECT doc_id, string_split(regexp_replace(text, '\\n\\n', chr(1), 'g'), chr(1)) AS parts FROM documents)),
    c AS (SELECT doc_id, section, body, unnest(generate_series(0, greatest(0, length(body) - 151), 750)) AS pos FROM s) SELECT doc_id, section, CAST(pos // 750 AS INTEGER) AS chunk, substring(body, pos + 1, 900) AS text FROM c""")
def knowledge_chunks(spark, sf_dir, size=900, overlap=150):
    """Texts in overlapping chunks by heading or blank line, each with its place."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", r"\n(?=#)|\n\n")).alias("section", "body"))
    step = size - overlap
    parts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.length("body") - overlap - 1), F.lit(step))
    return d.select("doc_id", "section", "body", F.posexplode(parts).alias("chunk", "at")).select("doc_id", "section", "chunk", F.substr("body", F.col("at") + 1, F.lit(size)).alias("text"))
