"""Vocabulary, encoding, split and Spark ML models (survey I1-I6, I15, D20, C3, A7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from .dims import join_dim, materialise as _dims_materialise
from .ranks import key_hash, positions, smallest_in_class

LABEL_ORDER = K.SEVERITY_LEVELS


def label_support(df: DataFrame, label: str) -> DataFrame:
    """Count per class and whether every class has at least two rows."""
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("all_supported", F.min("n").over(Window.partitionBy()) >= 2)


def _cat(c: str):
    return F.coalesce(F.col(c).cast("string"), F.lit(K.UNKNOWN))


def fit_vocab(df: DataFrame, columns=K.CATEGORICAL_FEATURES) -> DataFrame:
    """Per column: sorted distinct text values plus ``Unknown``; code = position.

    Long form (feature, value, code). One distinct over all columns (one shuffle), then
    range-partitioned positions: a column's values may be any number.
    """
    spark = df.sparkSession
    kv = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), _cat(c).alias("value")) for c in columns])).alias("kv")
    ).select("kv.feature", "kv.value")
    unknown = spark.createDataFrame([(c, K.UNKNOWN) for c in columns], "feature string, value string")
    d = kv.unionByName(unknown).distinct()
    return positions(d, "feature", "value", "code")


def encode(df: DataFrame, vocab: DataFrame, columns=K.CATEGORICAL_FEATURES, suffix: str = "_code") -> DataFrame:
    """Value -> code; unseen -> code of ``Unknown``; no ``Unknown`` -> 0, the first class.

    Each column is a left equi-join with its slice of the vocabulary (one row
    per distinct value), so adaptive execution broadcasts it when small and
    shuffles otherwise. The per-column ``Unknown`` codes are at most one scalar
    per column and are read once.
    """
    from .dims import sized
    vocab = sized(vocab, "vocab")   # one pass to build it, whatever the number of columns
    unk = {r["feature"]: r["code"] for r in
           vocab.filter(F.col("value") == K.UNKNOWN).select("feature", "code").collect()}
    for c in columns:
        v = vocab.filter(F.col("feature") == c).select(F.col("value").alias(f"_v_{c}"),
                                                      F.col("code").alias(f"_c_{c}"))
        df = join_dim(df.withColumn(f"_v_{c}", _cat(c)), v, f"_v_{c}", "left", name=f"vocab_{c}")
        df = (df.withColumn(f"{c}{suffix}", F.coalesce(F.col(f"_c_{c}"), F.lit(int(unk.get(c, 0)))))
              .drop(f"_v_{c}", f"_c_{c}"))
    return df


def feature_table(df: DataFrame, vocab: DataFrame) -> DataFrame:
    """The nine model features in fixed order as numeric columns."""
    enc = encode(df, vocab)
    return enc.withColumns({
        "f_event_type": F.col("event_type_code").cast("double"),
        "f_event_cause": F.col("event_cause_code").cast("double"),
        "f_requires_road_closure": F.coalesce(F.col("requires_road_closure"), F.lit(False)).cast("double"),
        "f_priority": F.col("priority_code").cast("double"),
        "f_corridor": F.col("corridor_code").cast("double"),
        "f_police_station": F.col("police_station_code").cast("double"),
        "f_hour": F.col("hour").cast("double"),
        "f_day_of_week": F.col("day_of_week").cast("double"),
        "f_is_peak_hour": F.col("is_peak_hour").cast("double"),
    })


FEATURE_COLS = tuple(f"f_{c}" for c in K.FEATURE_ORDER)


def row_key(df: DataFrame) -> DataFrame:
    """Text key of a training row: ``h-<incident_id>`` or ``f-<seq>``."""
    return df.withColumn("row_key", F.when(F.col("is_feedback"), F.concat(F.lit("f-"), F.col("seq").cast("string")))
                         .otherwise(F.concat(F.lit("h-"), F.col("incident_id").cast("string"))))


def split_flag(key_col: str = "row_key", seed: int = K.SPLIT_SEED) -> F.Column:
    """True for the ~20 % held-out rows: md5 prefix below 0x3333.

    A pure function of the row key: reproducible on any partitioning, no sort,
    no per-class window; each class is split in the same proportion in expectation.
    """
    h = F.substring(F.md5(F.concat(F.lit(f"{seed}-"), F.col(key_col))), 1, 4)
    return h < F.lit(K.TEST_FRACTION_PREFIX)


def stratified_split(df: DataFrame, label: str = "congestion_severity", key_col: str = "row_key",
                     seed: int = K.SPLIT_SEED, into: str = "is_test") -> DataFrame:
    """``df`` with the held-out flag, stratified by ``label`` when every class has two rows.

    Of a class of n rows the round(n / 5) (at least one, at most n - 1) with the smallest key hashes are held
    out, so each class is represented on both sides. The k-th smallest hash is found by a radix
    histogram (``smallest_in_class``): no sort and no window over a class, whatever share of the rows it has. Rows with
    one key (identical rows) stay on one side. Without that support the plain hash split applies, as in
    the original. A null label is a class of its own.
    """
    own = F.coalesce(F.col(label).cast("string"), F.lit(""))
    hashed = _materialise(df.select(own.alias("class"), key_hash(key_col, seed).alias("h")), "split_hashes")
    support = label_support(hashed, "class")
    if not support.agg(F.coalesce(F.bool_and("all_supported"), F.lit(False))).first()[0]:
        return df.withColumn(into, split_flag(key_col, seed))
    n = F.col("n")
    wanted = support.select("class", F.greatest(F.lit(1), F.least(n - 1, F.floor((2 * n + 5) / 10))).alias("k"))
    limits = smallest_in_class(hashed, wanted)
    out = join_dim(df.withColumn("class", own), limits, "class", name="split_limits")
    return out.withColumn(into, key_hash(key_col, seed) <= F.col("threshold")).drop("class", "threshold")


def label_index(col: str = "congestion_severity") -> F.Column:
    expr = None
    for i, lvl in enumerate(LABEL_ORDER):
        expr = F.when(F.col(col) == lvl, F.lit(float(i))) if expr is None else expr.when(F.col(col) == lvl, F.lit(float(i)))
    return expr


def _assembler():
    from pyspark.ml.feature import VectorAssembler
    return VectorAssembler(inputCols=list(FEATURE_COLS), outputCol="features", handleInvalid="keep")


def bins_for(train: DataFrame) -> int:
    """More bins than the largest code, so no two vocabulary values ever share one."""
    top = train.agg(*[F.max(F.col(c).cast("double")).alias(c) for c in FEATURE_COLS]).first()
    return max(64, 2 + int(max((v for v in top if v is not None), default=0)))


FEW_ROWS = 25_000           # rows that any cores fit and predict in seconds
FIT_ROWS = 500_000          # training rows of a partition: about 250 MB as bagged points of 100 trees


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt evenly over all cores, in partitions of at most about ``FIT_ROWS`` rows.

    Stored training rows are a few small files (nine small codes a row), so a scan of them has few partitions of
    uneven size; a fit keeps the partitions of its input and would leave most cores idle on every level, and so
    would a prediction by all trees. A table of ``FEW_ROWS`` or fewer stays as it is. A partition's rows are sorted by
    their features, if it has them: neighbours take the same way down each tree, so its nodes are found in the CPU's cache.
    """
    rows = df.count()
    if rows <= FEW_ROWS:
        return df
    dealt = df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // FIT_ROWS)))
    return dealt.sortWithinPartitions(*FEATURE_COLS) if set(FEATURE_COLS) <= set(df.columns) else dealt


def fit_severity(train: DataFrame, num_trees: int = 100, max_depth: int = 12, seed: int = K.SPLIT_SEED):
    """Weighted random forest classifier over the nine features (I4)."""
    from pyspark.ml import Pipeline

    from .forest import CodedForestClassifier
    # cacheNodeIds: a row's node in each tree is kept, instead of walked to from the root on every level
    rf = CodedForestClassifier(featuresCol="features", labelCol="label", weightCol="weight",
                               numTrees=num_trees, maxDepth=max_depth, maxBins=bins_for(train), seed=seed,
                               cacheNodeIds=True)
    rf.rows, rf.codes, rf.few = train.withColumn("label", label_index()), FEATURE_COLS, FEW_ROWS
    return Pipeline(stages=[_assembler(), rf]).fit(spread(train).withColumn("label", label_index()))


def fit_duration(train: DataFrame, num_trees: int = 100, max_depth: int = 12, seed: int = K.SPLIT_SEED):
    """Weighted random forest regressor on minutes."""
    from pyspark.ml import Pipeline

    from .forest import CodedForestRegressor
    rf = CodedForestRegressor(featuresCol="features", labelCol="duration_min", weightCol="weight",
                              numTrees=num_trees, maxDepth=max_depth, maxBins=bins_for(train), seed=seed,
                              featureSubsetStrategy="all", cacheNodeIds=True)
    rf.rows, rf.codes, rf.few = train, FEATURE_COLS, FEW_ROWS
    return Pipeline(stages=[_assembler(), rf]).fit(spread(train))


def severity_label(pred_col: str = "prediction") -> F.Column:
    arr = F.array(*[F.lit(x) for x in LABEL_ORDER])
    return F.get(arr, F.col(pred_col).cast("int"))


def classification_metrics(pred: DataFrame) -> DataFrame:
    """Accuracy over predicted rows (I6); one global aggregate."""
    return pred.agg(F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("accuracy"),
                    F.count(F.lit(1)).alias("n"))


def regression_metrics(pred: DataFrame, label: str = "duration_min") -> DataFrame:
    """R squared and mean absolute error in one pass of sums."""
    y, p = F.col(label), F.col("prediction")
    agg = pred.agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("sy"), F.sum(y * y).alias("syy"),
                   F.sum((y - p) * (y - p)).alias("sse"), F.sum(F.abs(y - p)).alias("sae"))
    sst = F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")
    return agg.select("n", (F.lit(1.0) - F.try_divide(F.col("sse"), sst)).alias("r2"),
                      F.try_divide(F.col("sae"), F.col("n")).alias("mae"))


def classifier_rows(train: DataFrame, fb: DataFrame) -> DataFrame:
    """History and ledger rows for the severity model, keyed and weighted."""
    from .feedback import training_union
    return row_key(training_union(train, fb))


def regressor_rows(train: DataFrame, fb: DataFrame) -> DataFrame:
    """Capped history durations and ledger actual durations, weighted (I5 input)."""
    from .clean import cap_duration, drop_missing, with_duration
    from .feedback import feedback_training_rows
    from .features import with_weight
    h = with_weight(cap_duration(with_duration(drop_missing(train, ["closed_datetime"]))), False)
    f = feedback_training_rows(fb).filter(F.col("duration_min").isNotNull())
    return row_key(h.unionByName(f, allowMissingColumns=True))


def _materialise(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared checkpoint folder and read back: lineage is cut and the
    table survives the loss of any executor during the iterative fits."""
    return _dims_materialise(df, name)


def retrain(train: DataFrame, fb: DataFrame, out_dir: str | None = None, num_trees: int = 100,
            max_depth: int = 12) -> DataFrame:
    """Refit both models on history plus ledger, evaluate on the held-out split (stratified by severity),
    refit on everything and publish (I15, I3-I6, A7). Returns one summary row.

    The models and the vocabulary are one version under ``out_dir``: readers keep the former version until all
    parts of the new one are written (``sources.publish``).
    """
    from ..session import work_path
    from ..sources.publish import publish
    spark = train.sparkSession
    out_dir = out_dir or work_path(spark, "models")
    crows = classifier_rows(train, fb)
    vocab = _materialise(fit_vocab(crows), "vocab")
    cfeat = _materialise(stratified_split(feature_table(crows, vocab))
                         .select("row_key", "is_test", "weight", "congestion_severity", *FEATURE_COLS),
                         "clf_rows")
    rfeat = _materialise(feature_table(regressor_rows(train, fb), vocab).withColumn("is_test", split_flag())
                         .select("row_key", "is_test", "weight", "duration_min", *FEATURE_COLS),
                         "reg_rows")
    clf_eval = fit_severity(cfeat.filter(~F.col("is_test")), num_trees, max_depth)
    test_pred = clf_eval.transform(spread(cfeat.filter(F.col("is_test"))).withColumn("label", label_index()))
    clf = fit_severity(cfeat, num_trees, max_depth)
    all_pred = clf.transform(spread(cfeat).withColumn("label", label_index()))
    n_reg, reg = rfeat.count(), None
    if n_reg > 0:
        reg_eval = fit_duration(rfeat.filter(~F.col("is_test")), num_trees, max_depth)
        reg_test = regression_metrics(reg_eval.transform(spread(rfeat.filter(F.col("is_test")))))
        reg = fit_duration(rfeat, num_trees, max_depth)
        reg_all = regression_metrics(reg.transform(spread(rfeat)))
    else:
        reg_test = reg_all = spark.createDataFrame([(0, None, None)], "n long, r2 double, mae double")
    publish(spark, out_dir, lambda folder: save_models(folder, vocab, clf, reg))
    ct = classification_metrics(test_pred).first()
    ca = classification_metrics(all_pred).first()
    rt, ra = reg_test.first(), reg_all.first()
    return spark.createDataFrame([(
        int(ca["n"]), int(n_reg), float(ct["accuracy"] or 0.0), float(ca["accuracy"] or 0.0),
        rt["r2"], rt["mae"], ra["r2"], out_dir)],
        "clf_rows long, reg_rows long, severity_test_accuracy double, severity_all_accuracy double, "
        "duration_test_r2 double, duration_test_mae double, duration_all_r2 double, model_path string")


def save_models(folder: str, vocab: DataFrame, severity, duration=None) -> None:
    """All parts of a model version into ``folder``."""
    # says whether a duration model belongs to this fit, so that loading need not guess from an error
    vocab.sparkSession.range(1).select(F.lit(duration is not None).alias("has_duration")).write.mode(
        "overwrite").parquet(f"{folder}/manifest")
    severity.write().overwrite().save(f"{folder}/severity")
    if duration is not None:
        duration.write().overwrite().save(f"{folder}/duration")
    vocab.write.mode("overwrite").parquet(f"{folder}/vocab")


def load_models(path: str):
    """(vocab DataFrame, severity PipelineModel, duration PipelineModel or None) of the published version."""
    from pyspark.ml import PipelineModel
    from pyspark.sql import SparkSession

    from ..sources.publish import current
    spark = SparkSession.getActiveSession()
    path = current(spark, path) or path                # a folder of parts is a version by itself
    vocab = spark.read.parquet(f"{path}/vocab")
    sev = PipelineModel.load(f"{path}/severity")
    has_duration = spark.read.parquet(f"{path}/manifest").first()["has_duration"]
    dur = PipelineModel.load(f"{path}/duration") if has_duration else None
    return vocab, sev, dur


def predict_requests(requests: DataFrame, vocab: DataFrame, sev_model, dur_model) -> DataFrame:
    """Model path of the forecast: severity label and raw duration per request (I4/I5 serving)."""
    from .features import is_peak
    feats = spread(feature_table(requests.withColumn("is_peak_hour", is_peak(F.col("hour"))), vocab))
    out = sev_model.transform(feats).withColumn("model_severity", severity_label())
    out = out.drop("features", "rawPrediction", "probability", "prediction")
    if dur_model is None:
        return out.withColumn("model_duration", F.lit(K.FALLBACK_DURATION))
    out = dur_model.transform(out).withColumnRenamed("prediction", "model_duration")
    return out.drop("features")
