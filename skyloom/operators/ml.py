"""Learned classifiers over catalog features and embeddings."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import IndexToString, StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.constants import PSF_FWHM_PIX
from skyloom.functions.photometry import clean

STAR_FEATURES = ["concentration", "gini", "half_light_radius", "sersic_n"]


def classify_stars(df: DataFrame, label: str, id_col: str) -> DataFrame:
    """``df`` with ``star_prob_ml``: a forest of 100 trees trained and applied on the same rows; null for all with fewer than two rows of a class. Missing features count as 0. An existing column of that name is replaced."""
    df = df.drop("star_prob_ml")
    have = [c for c in STAR_FEATURES if c in df.columns]
    fs = [F.coalesce(clean(F.col(c).cast("double")), F.lit(0.0)) for c in have]
    if "half_light_radius" in have:
        fs.append(F.coalesce(clean(F.col("half_light_radius").cast("double") / PSF_FWHM_PIX), F.lit(0.0)))
    x = df.withColumns({"_x": array_to_vector(F.array(*fs)), "_y": F.coalesce(F.col(label).cast("double"), F.lit(0.0))})
    classes = {r["_y"]: r["count"] for r in x.groupBy("_y").count().collect()}
    if min(classes.get(0.0, 0), classes.get(1.0, 0)) < 2:
        return df.withColumn("star_prob_ml", F.lit(None).cast("double"))
    model = RandomForestClassifier(featuresCol="_x", labelCol="_y", numTrees=100, seed=42).fit(x)
    return model.transform(x).withColumn("star_prob_ml", vector_to_array("probability")[1]).drop("_x", "_y", "rawPrediction", "probability", "prediction")


def embedding_columns(df: DataFrame, prefix: str = "zoobot_emb_") -> list[str]:
    """Scalar embedding columns in the order of their numbers."""
    return sorted((c for c in df.columns if c.startswith(prefix) and c[len(prefix) :].isdigit()), key=lambda c: int(c[len(prefix) :]))


def embedding_array(df: DataFrame, prefix: str = "zoobot_emb_"):
    """Those columns as one array; raises without any."""
    cols = embedding_columns(df, prefix)
    if not cols:
        raise ValueError("no embedding columns")
    return F.array(*[F.col(c).cast("double") for c in cols])


def with_embedding_columns(df: DataFrame, vector: str, size: int = 8, prefix: str = "zoobot_emb_") -> DataFrame:
    """An array column spread over scalar columns."""
    return df.withColumns({f"{prefix}{i}": F.get(F.col(vector), F.lit(i)).cast("float") for i in range(size)})


class MorphologyClassifier:
    """Perceptron (64, 32) or forest (100 trees, depth 10) over an array column. Rows with missing components get ``unknown``; fewer than ten labelled rows leave it unfitted."""

    def __init__(self, kind: str = "mlp", vector: str = "embeddings", size: int = 8):
        self.kind, self.vector, self.size, self.model, self.labels = kind, vector, size, None, []

    def _rows(self, df: DataFrame) -> DataFrame:
        ok = (F.size(self.vector) == self.size) & F.forall(self.vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        ok = F.coalesce(ok, F.lit(False))
        zero = F.array(*[F.lit(0.0)] * self.size)
        return df.withColumns({"_ok": ok, "_x": array_to_vector(F.when(ok, F.col(self.vector).cast("array<double>")).otherwise(zero))})

    def fit(self, df: DataFrame, label: str) -> "MorphologyClassifier":
        rows = self._rows(df).filter(F.col("_ok") & F.col(label).isNotNull())
        if rows.limit(10).count() < 10:
            return self
        index = StringIndexer(inputCol=label, outputCol="_y", stringOrderType="alphabetAsc").fit(rows)
        self.labels = list(index.labels)
        if self.kind == "mlp":
            clf = MultilayerPerceptronClassifier(featuresCol="_x", labelCol="_y", layers=[self.size, 64, 32, max(len(self.labels), 2)], seed=42, maxIter=60)
        else:
            clf = RandomForestClassifier(featuresCol="_x", labelCol="_y", numTrees=100, maxDepth=10, seed=42)
        self.model = Pipeline(stages=[clf, IndexToString(inputCol="prediction", outputCol="_l", labels=self.labels)]).fit(index.transform(rows))
        return self

    def classify(self, df: DataFrame, out: str = "morphology") -> DataFrame:
        """Adds the class, its probability and one probability column per class."""
        x = self._rows(df)
        if self.model is None:
            return x.drop("_ok", "_x").withColumns({out: F.lit("unknown"), f"{out}_confidence": F.lit(0.0)})
        p = self.model.transform(x).withColumn("_p", vector_to_array("probability"))
        prob = {f"{out}_prob_{c}": F.when(F.col("_ok"), F.col("_p")[i]).otherwise(0.0) for i, c in enumerate(self.labels)}
        p = p.withColumns({out: F.when(F.col("_ok"), F.col("_l")).otherwise("unknown"), f"{out}_confidence": F.when(F.col("_ok"), F.array_max("_p")).otherwise(0.0), **prob})
        return p.drop("_ok", "_x", "_p", "_l", "rawPrediction", "probability", "prediction")


def train_morphology(df: DataFrame, label: str, **options) -> MorphologyClassifier:
    """A fitted classifier; raises if the label is missing or there are fewer than ten usable rows."""
    if label not in df.columns:
        raise ValueError(f"no column {label}")
    c = MorphologyClassifier(**options).fit(df, label)
    if c.model is None:
        raise ValueError("fewer than ten usable labelled rows")
    return c
