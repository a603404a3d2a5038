"""Queries of model preparation, sampling and estimators."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabaudit.catalog import query
from tabaudit.catalog.fixtures import (
    DIRTY_ORDERS_SQL,
    DOC_QUALITY_SQL,
    EMBEDDING_ROWS_SQL,
    audit_lineitem,
    dirty_orders,
    doc_quality,
    emb_binary,
    rounded,
    table,
)
from tabaudit.functions.columns import col
from tabaudit.functions.storage import materialize
from tabaudit.operators import prep, sampling
from tabaudit.operators.clean import dedupe
from tabaudit.operators.components import fit_leading
from tabaudit.operators.models import FourierFeatures, fit_classifier, fourier_weights, positive_score
from tabaudit.operators.neighbours import hashed_neighbours, recall
from tabaudit.operators.prep import PrepSpec, centred, components_kept, fit_pca, fit_prep, fit_prep_folds
from tabaudit.operators.smote import smote
from tabaudit.operators.splits import stratified_folds
from tabaudit.plans.specs import expand_grid


@query(
    f"""
    with {DIRTY_ORDERS_SQL}, deduped as (select distinct * from dirty),
      middle as (select quantile_cont(o_totalprice, 0.5) as m from deduped)
    select o_orderkey, round(coalesce(o_totalprice, m), 6) as o_totalprice from deduped, middle
    """
)
def impute_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = dedupe(dirty_orders(spark, sf_dir))
    fitted = fit_prep(df, ["o_totalprice"], PrepSpec(imputer="simple"))
    return rounded(fitted.apply(df, ["o_orderkey"]), 6, "o_totalprice")


@query(
    """
    with m as (select avg(l_quantity) as qm, stddev_pop(l_quantity) as qs, avg(l_tax) as tm, stddev_pop(l_tax) as ts from lineitem)
    select l_orderkey, l_linenumber, round((l_quantity - qm) / qs, 6) as l_quantity,
           round((l_tax - tm) / ts, 6) as l_tax, 0.0::double as k
    from lineitem, m
    """
)
def standard_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a constant column ``k``, which is only centred."""
    df = table(spark, sf_dir, "lineitem").withColumn("k", F.lit(1.0))
    names = ["l_quantity", "l_tax", "k"]
    fitted = fit_prep(df, names, PrepSpec(scaler="standard"))
    return rounded(fitted.apply(df, ["l_orderkey", "l_linenumber"]), 6, *names)


@query(
    """
    with v as (
      select 'l_quantity' as feature, var_pop(l_quantity) as v from lineitem
      union all select 'l_extendedprice', var_pop(l_extendedprice) from lineitem
      union all select 'l_discount', var_pop(l_discount) from lineitem
      union all select 'l_tax', var_pop(l_tax) from lineitem
      union all select 'l_linenumber', var_pop(l_linenumber) from lineitem)
    select feature from v where v > 0.5
    """
)
def variance_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = audit_lineitem(spark, sf_dir)
    df = data.x.withColumn("k", F.lit(1.0))
    fitted = fit_prep(df, df.columns, PrepSpec(variance_threshold=0.5))
    return spark.createDataFrame([(f,) for f in fitted.features], "feature string")


_F_SQL = f"""
    with {DOC_QUALITY_SQL}, long as (
      select 'n_chars' as feature, 0 as position, quality, cast(n_chars as double) as x from docs
      union all select 'n_words', 1, quality, n_words from docs
      union all select 'mean_word', 2, quality, mean_word from docs),
    per_class as (
      select feature, position, quality, count(*) as n, avg(x) as m, var_pop(x) as v from long group by all),
    grand as (select feature, avg(x) as g, count(*) as n from long group by feature),
    scores as (
      select c.feature, c.position,
             (sum(c.n * (c.m - g.g) * (c.m - g.g)) / (count(*) - 1))
               / (sum(c.n * c.v) / (max(g.n) - count(*))) as f_score
      from per_class c join grand g on c.feature = g.feature group by c.feature, c.position)
"""


@query(f"{_F_SQL} select feature, position, round(f_score, 6) as f_score from scores")
def anova_f_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = doc_quality(spark, sf_dir)
    return rounded(prep.anova_f_scores(data.df, data.features, data.target), 6, "f_score")


@query("""
    with long as (
      select 'l_quantity' as feature, 0 as position, l_partkey as class, cast(l_quantity as double) as x from lineitem
      union all select 'l_extendedprice', 1, l_partkey, cast(l_extendedprice as double) from lineitem
      union all select 'l_discount', 2, l_partkey, cast(l_discount as double) from lineitem),
    per_class as (select feature, position, class, count(x) as n, avg(x) as m, var_pop(x) as v from long group by all),
    grand as (select feature, avg(x) as g, count(x) as n from long group by feature)
    select c.feature, c.position,
           round((sum(c.n * (c.m - g.g) * (c.m - g.g)) / (count(*) - 1)) / (sum(c.n * c.v) / (max(g.n) - count(*))), 6) as f_score
    from per_class c join grand g on c.feature = g.feature group by c.feature, c.position
""")
def anova_many_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F scores for a target with a class for each part."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return rounded(prep.anova_f_scores(items, ["l_quantity", "l_extendedprice", "l_discount"], "l_partkey"), 6, "f_score")


@query(f"{_F_SQL} select feature from scores order by f_score desc, position desc limit 2")
def select_k_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = doc_quality(spark, sf_dir)
    fitted = fit_prep(data.df, data.features, PrepSpec(select_k_best=2), data.target)
    return spark.createDataFrame([(f,) for f in fitted.features], "feature string")


@query(
    f"""
    with {EMBEDDING_ROWS_SQL},
    per_class as (select i, target, count(*) as n, avg(x) as m, var_pop(x) as v from entries group by i, target),
    grand as (select i, avg(x) as g, count(*) as n from entries group by i),
    scores as (
      select c.i, (sum(c.n * (c.m - g.g) * (c.m - g.g)) / (count(*) - 1))
               / (sum(c.n * c.v) / (max(g.n) - count(*))) as f
      from per_class c join grand g on c.i = g.i group by c.i)
    select 'x' || i as feature from scores where f > (select quantile_cont(f, 0.75) from scores)
    """
)
def select_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The upper quarter of 64 features; no score lies on the cut."""
    data = emb_binary(spark, sf_dir)
    fitted = fit_prep(data.df, data.features, PrepSpec(select_percentile=25), data.target)
    return spark.createDataFrame([(f,) for f in fitted.features], "feature string")


_PCA_SQL = """
    with c as (
      select var_samp(l_quantity) as a, covar_samp(l_quantity, e) as b, var_samp(e) as d
      from (select l_quantity, l_extendedprice / 1000 as e from lineitem)),
    r as (select a, b, d, sqrt((a - d) * (a - d) / 4 + b * b) as s from c)
"""


@query(
    f"""
    {_PCA_SQL}
    select 1 as component, round(((a + d) / 2 + s) / (a + d), 6) as share from r
    union all select 2, round(((a + d) / 2 - s) / (a + d), 6) from r
    """
)
def pca_explained_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _price_vectors(spark, sf_dir)[1]
    shares = fit_pca(vectors, "v", "c", 2).explainedVariance.toArray()
    rows = [(i + 1, float(s)) for i, s in enumerate(shares)]
    return rounded(spark.createDataFrame(rows, "component int, share double"), 6, "share")


def _price_vectors(spark: SparkSession, sf_dir: str) -> tuple[int, DataFrame]:
    df = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", (F.col("l_extendedprice") / 1000).alias("e")
    )
    fitted = centred(fit_prep(df, ["l_quantity", "e"], PrepSpec()), df)
    return len(fitted.features), PipelineModel(fitted.stages("v")).transform(df)


@query(
    f"""
    {_PCA_SQL},
    axis as (select b / sqrt(b * b + (l - a) * (l - a)) as u, (l - a) / sqrt(b * b + (l - a) * (l - a)) as w
             from (select a, b, (a + d) / 2 + s as l from r)),
    m as (select avg(l_quantity) as qm, avg(l_extendedprice / 1000) as em from lineitem)
    select l_orderkey, l_linenumber,
           round(abs((l_quantity - qm) * u + (l_extendedprice / 1000 - em) * w), 5) as first_component
    from lineitem, axis, m
    """
)
def pca_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Absolute first component: the sign of an axis is arbitrary."""
    p, vectors = _price_vectors(spark, sf_dir)
    model = fit_pca(vectors, "v", "c", p)
    kept = components_kept(model.explainedVariance.toArray(), 0.5)
    first = F.abs(F.element_at(vector_to_array(F.col("c")), kept))
    return model.transform(vectors).select(
        "l_orderkey", "l_linenumber", F.round(first, 5).alias("first_component")
    )


@query(
    f"""
    with {DIRTY_ORDERS_SQL}, deduped as (select distinct * from dirty),
    classes as (
      select o_orderstatus, sum(count(*)) over (order by o_orderstatus) - count(*) as start
      from deduped group by o_orderstatus),
    ranked as (
      select *, row_number() over (partition by o_orderstatus order by md5('42:' || o_orderkey), o_orderkey) as rn
      from deduped),
    folded as (
      select o_orderkey, o_totalprice, o_custkey, cast((start + rn - 1) % 3 as int) as fold
      from ranked r join classes c on r.o_orderstatus = c.o_orderstatus),
    middle as (
      select f.fold, quantile_cont(d.o_totalprice, 0.5) as m
      from (select distinct fold from folded) f join folded d on d.fold <> f.fold group by f.fold),
    fitted as (
      select f.fold, m, avg(coalesce(o_totalprice, m)) as pm, stddev_pop(coalesce(o_totalprice, m)) as ps,
             avg(o_custkey) as cm, stddev_pop(o_custkey) as cs
      from middle f join folded d on d.fold <> f.fold group by f.fold, m)
    select o_orderkey, d.fold, round((coalesce(o_totalprice, m) - pm) / ps, 6) as o_totalprice,
           round((o_custkey - cm) / cs, 6) as o_custkey
    from folded d join fitted f on d.fold = f.fold
    """
)
def chain_impute_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each fold is imputed and scaled with what the other folds taught."""
    df = dedupe(dirty_orders(spark, sf_dir))
    folded = materialize(stratified_folds(df, "o_orderstatus", "o_orderkey", 3), "chain", ["fold"])
    names = ["o_totalprice", "o_custkey"]
    spec = PrepSpec(imputer="simple", scaler="standard")
    fitted = fit_prep_folds(folded, names, spec, None, "fold", [0, 1, 2])
    parts = [p.apply(folded.filter(F.col("fold") == i), ["o_orderkey", "fold"]) for i, p in enumerate(fitted)]
    return rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]), 6, *names)


@query(
    """
    with grid as (
      select cast(row_number() over (order by a, b) - 1 as int) as cand_id, a as min_chars, b as source
      from (values (500), (2000)) x(a), (values ('src0'), ('src1'), ('src2')) y(b))
    select cand_id, min_chars, g.source, count(d.doc_id) as n
    from grid g left join documents d on d.source = g.source and d.n_chars > g.min_chars
    group by cand_id, min_chars, g.source
    """
)
def param_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents each parameter combination takes in, in one pass."""
    grid = expand_grid({"rule__source": ["src0", "src1", "src2"], "rule__min_chars": [500, 2000]})
    docs = table(spark, sf_dir, "documents")
    row = docs.agg(
        *[
            F.count_if((F.col("source") == c.step("rule")["source"]) & (F.col("n_chars") > c.step("rule")["min_chars"])).alias(
                f"n{c.cand_id}"
            )
            for c in grid
        ]
    )
    entries = [
        F.struct(
            F.lit(c.cand_id).alias("cand_id"),
            F.lit(c.step("rule")["min_chars"]).alias("min_chars"),
            F.lit(c.step("rule")["source"]).alias("source"),
            F.col(f"n{c.cand_id}").alias("n"),
        )
        for c in grid
    ]
    return row.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


@query(
    f"""
    {_PCA_SQL}
    select 1 as component, round(((a + d) / 2 + s) / (a + d), 6) as share from r
    union all select 2, round(((a + d) / 2 - s) / (a + d), 6) from r
    """
)
def pca_leading_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same shares by a thin basis, scans and a tree of triangles."""
    shares = fit_leading(_price_vectors(spark, sf_dir)[1], "v", "c", 2).shares
    rows = [(i + 1, float(s)) for i, s in enumerate(shares)]
    return rounded(spark.createDataFrame(rows, "component int, share double"), 6, "share")


@query()
def pca_leading_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four components of the embeddings, axes signed by their largest entry."""
    data = emb_binary(spark, sf_dir)
    fitted = centred(fit_prep(data.df, data.features, PrepSpec()), data.df)
    vectors = PipelineModel(fitted.stages("v")).transform(data.df)
    made = fit_leading(vectors, "v", "c", 4).model.transform(vectors)
    return made.select("vec_id", *[F.round(vector_to_array(F.col("c"))[i], 6).alias(f"c{i}") for i in range(4)])


_RANKED_LABELS = """
    with ranked as (
      select doc_id, quality, count(*) over (partition by quality) as n,
             row_number() over (partition by quality order by md5('42:' || doc_id), doc_id) as rn
      from labels),
    extent as (select min(n) as low, max(n) as high from ranked)
"""


@query(f"{_RANKED_LABELS} select doc_id, quality from ranked, extent where rn <= low")
def undersample(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return sampling.undersample(labels, "quality", "doc_id")


@query(
    f"""
    {_RANKED_LABELS}
    select doc_id, quality, unnest(range(1, high // n + (case when rn <= high % n then 1 else 0 end) + 1)) as copy
    from ranked, extent
    """
)
def oversample(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return sampling.oversample(labels, "quality", "doc_id")


@query(
    f"""
    with {DOC_QUALITY_SQL},
    sized as (select *, count(*) over (partition by quality) as n from docs),
    ranked as (
      select doc_id, quality, [cast(n_chars as double), cast(n_words as double)] as v, n, max(n) over () as high,
             row_number() over (partition by quality order by md5('42:' || doc_id), cast(doc_id as varchar)) as rn
      from sized),
    minority as (select * from ranked where n < high),
    near as (
      select a.doc_id, b.v as to_v,
             row_number() over (
               partition by a.doc_id
               order by (a.v[1] - b.v[1]) * (a.v[1] - b.v[1]) + (a.v[2] - b.v[2]) * (a.v[2] - b.v[2]), b.v) as slot
      from minority a join minority b on a.quality = b.quality and a.doc_id <> b.doc_id),
    copies as (
      select *, unnest(range(2, high // n + (case when rn <= high % n then 1 else 0 end) + 1)) as copy from minority),
    marked as (select *, md5('42:' || doc_id || ':' || copy) as mark from copies),
    drawn as (
      select *, cast(('0x' || substr(mark, 1, 8)) as bigint) % least(5, n - 1) + 1 as slot,
             cast(('0x' || substr(mark, 9, 8)) as bigint) / 4294967296.0::double as gap from marked),
    made as (
      select m.doc_id || '#' || m.copy as doc_id, m.quality,
             m.v[1] + gap * (b.to_v[1] - m.v[1]) as n_chars, m.v[2] + gap * (b.to_v[2] - m.v[2]) as n_words
      from drawn m join near b on b.doc_id = m.doc_id and b.slot = m.slot)
    select doc_id, quality, round(n_chars, 4) as n_chars, round(n_words, 4) as n_words from made
    union all
    select cast(doc_id as varchar), quality, n_chars, n_words from docs
    """
)
def smote_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    vector = F.array(F.col("n_chars").cast("double"), F.col("n_words").cast("double"))
    docs = doc_quality(spark, sf_dir).df.select("doc_id", "quality", vector.alias("v"))
    made = smote(docs, "quality", "doc_id", "v", method="exact")
    return made.select(
        "doc_id",
        "quality",
        F.round(F.col("v")[0], 4).alias("n_chars"),
        F.round(F.col("v")[1], 4).alias("n_words"),
    )


@query()
def smote_hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings of ten classes, balanced with neighbours from hash tables of 64 dimensions."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    return smote(vectors, "label", "vec_id", "v")


@query(
    """
    select 'all' as "group", least(200, count(*)) * least(5, count(*) - 1) as wanted, true as reached
    from (select distinct embedding from embeddings)
    """
)
def neighbour_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether small buckets find nine of ten neighbours in 64 dimensions, against all distances."""
    vectors = table(spark, sf_dir, "embeddings").select(F.lit("all").alias("group"), F.col("embedding").cast("array<double>").alias("vector"))
    points = materialize(vectors.groupBy("group", "vector").agg(F.count(F.lit(1)).alias("size")), "points")
    found = hashed_neighbours(points, 5, 42, cell_rows=250)
    return recall(points, found, 5).select("group", "wanted", (F.col("found") >= 0.9 * F.col("wanted")).alias("reached"))


# -- estimators -------------------------------------------------------------------------

_W, _B = fourier_weights(2, 3, 0.5, 42)
_RFF_SQL = ", ".join(
    f"round(sqrt(2.0 / 3) * cos(l_discount * 10 * ({float(_W[0, j])!r}) + l_tax * 10 * ({float(_W[1, j])!r}) + ({float(_B[j])!r})), 6) as f{j}"
    for j in range(3)
)


@query(f"select l_orderkey, l_linenumber, {_RFF_SQL} from lineitem")
def rff_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_discount") * 10).alias("a"), (F.col("l_tax") * 10).alias("b")
    )
    vectors = VectorAssembler(inputCols=["a", "b"], outputCol="v").transform(df)
    made = FourierFeatures(inputCol="v", outputCol="f", size=3, inputSize=2, gamma=0.5, seed=42).transform(vectors)
    entries = vector_to_array(F.col("f"))
    return made.select(
        "l_orderkey", "l_linenumber", *[F.round(F.get(entries, F.lit(j)), 6).alias(f"f{j}") for j in range(3)]
    )


def _fitted_scores(spark: SparkSession, sf_dir: str, kind: str, params: dict) -> DataFrame:
    """Fit on all embeddings and score them; tests fit the same by hand."""
    data = emb_binary(spark, sf_dir)
    df = materialize(data.df.withColumn("label", col(data.target).cast("double")), "embeddings")
    fitted = fit_prep(df, data.features, PrepSpec(imputer="simple", scaler="standard"))
    rows = PipelineModel(fitted.stages("features")).transform(df).select(data.key, "label", "features")
    model = fit_classifier(kind, params, rows, fitted.n_rows, len(fitted.features), 42)
    return model.transform(rows).select(data.key, "label", "prediction", positive_score(kind).alias("score"))


@query()
def linear_svm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fitted_scores(spark, sf_dir, "svc", {"kernel": "linear", "C": 1.0})


@query()
def rbf_svm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fitted_scores(spark, sf_dir, "svc", {"C": 1.0, "gamma": "scale"})


@query()
def random_forest_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fitted_scores(spark, sf_dir, "random_forest", {"n_estimators": 20, "max_depth": 5})
