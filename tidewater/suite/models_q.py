"""Queries of language profiles (X8), topic coherence (X20), stemming (X4), valence sentiment (X10), single linkage (M13), tree explanations
and synthetic oversampling (M31)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.operators import explain as EX
from tidewater.operators import features as E
from tidewater.operators import langid as LI
from tidewater.operators import linkage as LK
from tidewater.operators import ml as ML
from tidewater.operators import text as X
from tidewater.operators import stemming as ST
from tidewater.operators import topics as TP
from tidewater.operators import valence as VL
from tidewater.session import staged
from tidewater.suite import register
from tidewater.suite.ml_q import classification, embedding_points
from tidewater.suite.sqlgen import r6
from tidewater.suite.text_q import WORD_SQL, _with_pre, docs, docs_sliced, pre, pre_sliced

_W = TP.WINDOW


@register("text_coherence_cv", _with_pre(f"SELECT topic, {r6('avg(m)')} AS c_v FROM cosines GROUP BY topic", f"""
top AS (SELECT topic, term FROM (SELECT lang AS topic, term, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, term) AS r
  FROM (SELECT doc_id, unnest(tokens) AS term FROM pre) u JOIN docs USING (doc_id) GROUP BY lang, term) WHERE r <= 10),
total AS (SELECT CAST(sum(greatest(len(tokens) - {_W - 1}, 1)) AS DOUBLE) AS n FROM pre WHERE len(tokens) > 0),
occ AS (SELECT * FROM (SELECT doc_id, len(tokens) AS size, unnest(tokens) AS term, unnest(range(len(tokens))) AS pos FROM pre) WHERE term IN (SELECT term FROM top)),
seen AS (SELECT DISTINCT doc_id, term, unnest(range(greatest(0, pos - {_W - 1}), least(pos, greatest(size - {_W}, 0)) + 1)) AS s FROM occ),
single AS (SELECT term, CAST(count(*) AS DOUBLE) AS c FROM seen GROUP BY term),
joint AS (SELECT a.term AS x, b.term AS y, count(*) AS c FROM seen a JOIN seen b USING (doc_id, s) GROUP BY 1, 2),
cells AS (SELECT a.topic, a.term AS x, b.term AS y, coalesce(j.c, 0) / n + {TP.EPSILON} AS p, (sx.c / n) * (sy.c / n) AS q
  FROM top a JOIN top b USING (topic) JOIN single sx ON sx.term = a.term JOIN single sy ON sy.term = b.term LEFT JOIN joint j ON j.x = a.term AND j.y = b.term, total),
npmi AS (SELECT topic, x, y, CASE WHEN p >= 1 THEN 1.0 ELSE ln(p / q) / -ln(p) END AS v FROM cells),
whole AS (SELECT topic, y, sum(v) AS s FROM npmi GROUP BY 1, 2),
cosines AS (SELECT topic, x, sum(v * s) / sqrt(sum(v * v) * sum(s * s)) AS m FROM npmi JOIN whole USING (topic, y) GROUP BY 1, 2)"""))
def text_coherence_cv(spark, d):
    """c_v of the most frequent words of each language."""
    p = staged(pre(spark, d).select("doc_id", "tokens").join(docs(spark, d).select("doc_id", "lang"), "doc_id"), "tokens")
    return TP.cv_coherence(p, TP.group_topics(p, "lang", 10))


@register("text_lda_coherence")
def text_lda_coherence(spark, d):
    """c_v of LDA topics."""
    p = X.on_disk(pre_sliced(spark, d).select("doc_id", "tokens"))
    out = TP.cv_coherence(p, X.lda_topics(p, k=5))
    p.unpersist()  # what the result reads is written by now
    return out


# Prim's algorithm, one point a round: the lengths are those of any minimum spanning tree.
_PRIM = """
p AS MATERIALIZED (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
prim(id, best, parent, done) USING KEY (id) AS (
  SELECT id, CASE WHEN id = (SELECT min(id) FROM p) THEN 0.0 ELSE CAST('infinity' AS DOUBLE) END, CAST(NULL AS BIGINT), false FROM p
  UNION
  SELECT id, CASE WHEN id = vid THEN best ELSE dist END, CASE WHEN id = vid THEN parent ELSE vid END, id = vid FROM (
    SELECT r.id, r.best, r.parent, m.id AS vid, list_distance(pr.v, pm.v) AS dist
    FROM recurring.prim r JOIN p pr ON pr.id = r.id, (SELECT id FROM recurring.prim WHERE NOT done ORDER BY best, id LIMIT 1) m JOIN p pm ON pm.id = m.id
    WHERE NOT r.done) WHERE id = vid OR dist < best),
tree AS MATERIALIZED (SELECT least(id, parent) AS a, greatest(id, parent) AS b, best AS height FROM prim WHERE parent IS NOT NULL)"""


@register("ml_merges", f"""
WITH RECURSIVE {_PRIM}
SELECT CAST(row_number() OVER (ORDER BY height) AS INT) AS merge, {r6('height')} AS height FROM tree""")
def ml_merges(spark, d):
    """The heights at which single linkage merges, in order."""
    from tidewater.plans.ordered import add_positions
    tree = LK.spanning_tree(embedding_points(spark, d))
    return add_positions(tree.withColumn("one", F.lit(1)), ["one"], ["height", "a", "b"], F.floor(F.col("height") * 64)).select(
        (F.col("_pos") + 1).cast("int").alias("merge"), "height")


@register("ml_agglomerative", f"""
WITH RECURSIVE {_PRIM},
kept AS MATERIALIZED (SELECT a, b FROM (SELECT *, row_number() OVER (ORDER BY height DESC, a DESC, b DESC) AS r FROM tree) WHERE r > 9),
edges AS MATERIALIZED (SELECT a, b FROM kept UNION ALL SELECT b, a FROM kept),
reach AS (SELECT id, id AS root FROM p UNION SELECT e.b, r.root FROM reach r JOIN edges e ON e.a = r.id)
SELECT id, min(root) AS cluster FROM reach GROUP BY id""")
def ml_agglomerative(spark, d):
    """Ten clusters by single linkage."""
    return LK.agglomerative(embedding_points(spark, d), k=10)[0]


@register("ml_explain_tree")
def ml_explain_tree(spark, d):
    """Shapley values of a random forest: the mean absolute one of each feature."""
    train, test, _, names, kind = classification(spark, d)
    model = ML.estimator("random_forest", kind).fit(train.select("features", "label"))
    return EX.tree_importance(EX.tree_explanations(model, test), names)


def _num(text: str) -> str:
    return f"CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT)"


@register("ml_smote", f"""
WITH e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings),
cnt AS (SELECT label, count(*) AS n, max(count(*)) OVER () - count(*) AS missing FROM e GROUP BY label),
ranked AS (SELECT id, label, n, missing, row_number() OVER (PARTITION BY label ORDER BY {_num("'42:' || id")}, id) - 1 AS pos FROM e JOIN cnt USING (label)),
copies AS (SELECT id, label, n, unnest(range(1, missing // n + CASE WHEN pos < missing % n THEN 2 ELSE 1 END)) AS copy FROM ranked),
picked AS (SELECT *, {_num("'42:' || id || ':' || copy || ':n'")} % least(5, n - 1) + 1 AS rn, {_num("'42:' || id || ':' || copy || ':w'")} / 4294967296.0::DOUBLE AS weight FROM copies),
near AS (SELECT a.id, b.id AS nid, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.v, b.v), b.id) AS rn FROM e a JOIN e b ON a.label = b.label AND a.id <> b.id),
made AS (SELECT k.id, copy, k.label, nid, weight, list_transform(list_zip(x.v, y.v), lambda t: t[1] + weight * (t[2] - t[1])) AS v
  FROM picked k JOIN near USING (id, rn) JOIN e x ON x.id = k.id JOIN e y ON y.id = nid
  UNION ALL SELECT id, 0, label, NULL, 0.0, v FROM e)
SELECT id, CAST(copy AS INT) AS copy, label, nid, {r6('weight')} AS weight, {r6('v[1]')} AS first, {r6('list_sum(v)')} AS total FROM made""")
def ml_smote(spark, d):
    """Embeddings with every class grown to the size of the largest one."""
    total = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x)
    return E.smote(embedding_points(spark, d)).select("id", "copy", "label", "nid", "weight", F.col("vec")[0].alias("first"), total.alias("total"))


@register("text_stems")
def text_stems(spark, d):
    """How many tokens each stem of the English documents has."""
    p = pre(spark, d).select("doc_id", "tokens").join(docs(spark, d).where("lang = 'en'").select("doc_id"), "doc_id")
    return ST.stemmed(p).select(F.explode(X.exploded("tokens")).alias("stem")).groupBy("stem").agg(F.count(F.lit(1)).alias("n"))


def _words(ws) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in ws) + "]"


def _push(k: int) -> str:
    return f"CASE WHEN b{k} IN {_words(VL.STRONGER)} THEN {VL.BOOST} * {VL.DISTANCE[k - 1]} WHEN b{k} IN {_words(VL.WEAKER)} THEN -{VL.BOOST} * {VL.DISTANCE[k - 1]} ELSE 0.0 END"


_VALENCE_LEX = ", ".join(f"('{k}', CAST({4.0 * p} AS DOUBLE))" for k, (p, _) in sorted(VL.SENTIMENT_SEED.items()))


@register("text_sentiment_valence", f"""
WITH lex(token, valence) AS (VALUES {_VALENCE_LEX}),
tx AS (SELECT doc_id, text, regexp_extract_all(lower(text), '{WORD_SQL}') AS w FROM documents WHERE text IS NOT NULL),
sp AS (SELECT doc_id, coalesce(list_position(w, 'but'), 0) AS but, w[i] AS token, i, CASE WHEN i > 1 THEN w[i - 1] END AS b1, CASE WHEN i > 2 THEN w[i - 2] END AS b2, CASE WHEN i > 3 THEN w[i - 3] END AS b3
  FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM tx)),
hit AS (SELECT *, (valence + sign(valence) * ({' + '.join(_push(k) for k in (1, 2, 3))}))
  * power(CAST({VL.NEGATE} AS DOUBLE), {' + '.join(f"CASE WHEN b{k} IN {_words(VL.NEGATIONS)} THEN 1 ELSE 0 END" for k in (1, 2, 3))})
  * CASE WHEN but = 0 OR i = but THEN 1.0 WHEN i < but THEN {VL.BEFORE_BUT} ELSE {VL.AFTER_BUT} END AS v FROM sp JOIN lex USING (token)),
sums AS (SELECT doc_id, sum(v) AS s, count(*) AS matched FROM hit GROUP BY doc_id),
mk AS (SELECT doc_id, len(text) - len(replace(text, '!', '')) AS e, len(text) - len(replace(text, '?', '')) AS q FROM tx),
al AS (SELECT mk.doc_id, coalesce(s, 0.0) AS s, coalesce(matched, 0) AS matched,
  least(e, {VL.MOST_EXCLAIM}) * {VL.EXCLAIM} + CASE WHEN q > 3 THEN {VL.MANY_QUESTIONS} WHEN q > 1 THEN q * {VL.QUESTION} ELSE 0.0 END AS marks FROM mk LEFT JOIN sums USING (doc_id)),
c AS (SELECT doc_id, matched, (s + sign(s) * marks) / sqrt((s + sign(s) * marks) * (s + sign(s) * marks) + {VL.ALPHA}) AS compound FROM al)
SELECT doc_id, {r6('compound')} AS compound, CAST(matched AS BIGINT) AS matched,
  CASE WHEN compound >= 0.05 THEN 'positive' WHEN compound <= -0.05 THEN 'negative' ELSE 'neutral' END AS label FROM c""")
def text_sentiment_valence(spark, d):
    return VL.valence_sentiment(docs_sliced(spark, d))


_HELD = _num("CAST(doc_id AS VARCHAR)") + " % 5 = 0"
_LANGID = f"""
g AS MATERIALIZED (SELECT doc_id, lang, gram, count(*) AS c FROM (
  SELECT doc_id, lang, substr(t, unnest(range(1, len(t) - {LI.SIZE - 2})), {LI.SIZE}) AS gram FROM (SELECT doc_id, lang, lower(text) AS t FROM documents WHERE len(text) >= {LI.SIZE})) GROUP BY 1, 2, 3),
k AS MATERIALIZED (SELECT lang, gram, CAST(sum(c) AS DOUBLE) AS c FROM g WHERE lang IS NOT NULL AND NOT ({_HELD}) GROUP BY 1, 2),
tot AS (SELECT lang, sum(c) AS n FROM k GROUP BY lang),
voc AS (SELECT DISTINCT gram FROM k),
lp AS MATERIALIZED (SELECT tot.lang, voc.gram, ln((coalesce(k.c, 0) + 1) / (n + (SELECT count(*) FROM voc))) AS lp FROM tot CROSS JOIN voc LEFT JOIN k ON k.lang = tot.lang AND k.gram = voc.gram),
sc AS (SELECT g.doc_id, lp.lang, sum(g.c * lp) / sum(g.c) AS s FROM g JOIN lp USING (gram) GROUP BY 1, 2),
best AS (SELECT doc_id, lang, s FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, lang) AS r FROM sc) WHERE r = 1),
found AS (SELECT d.doc_id, {_HELD.replace('doc_id', 'd.doc_id')} AS held_out, d.lang, coalesce(best.lang, '{LI.UNKNOWN}') AS detected, coalesce(s, 0.0) AS s FROM documents d LEFT JOIN best USING (doc_id))"""


def _trained(spark, d):
    from tidewater.sources.tables import table
    held = F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 8), 16, 10).cast("long") % 5 == 0
    rows = table(spark, d, "documents").select("doc_id", "lang", "text", held.alias("held_out"))
    return rows, LI.identify(rows, *LI.learn_profiles(rows.where(~F.col("held_out"))))


@register("text_language_trained", f"WITH {_LANGID}\nSELECT doc_id, held_out, detected, {r6('s')} AS log_likelihood FROM found")
def text_language_trained(spark, d):
    """The language of every document by profiles learnt from four fifths of them."""
    rows, found = _trained(spark, d)
    return rows.select("doc_id", "held_out").join(found, "doc_id")


@register("text_language_accuracy", f"""WITH {_LANGID}
SELECT lang AS language, CAST(count(*) AS BIGINT) AS n, {r6('avg(CASE WHEN detected = lang THEN 1.0 ELSE 0.0 END)')} AS correct FROM found WHERE held_out AND lang IS NOT NULL GROUP BY lang""")
def text_language_accuracy(spark, d):
    """How many of the documents that were not learnt from are recognised."""
    rows, found = _trained(spark, d)
    return LI.accuracy(found, rows.where("held_out"))
