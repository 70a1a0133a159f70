"""Custom ``pyspark.ml`` stages for semantics MLlib lacks; all persist with the pipeline.

* ``KnownColumns``     - columns known from training that are missing become NULL (imputed)
* ``NumericCoerce``    - numeric strings to doubles, unparsable and non-finite -> NULL
* ``ExactScaler``      - exact-median imputation + population-std scaling (std 0 -> 0)
* ``CategoryEncoder``  - label stripping, mode imputation, sorted categories; one-hot (unknown -> zeros)
* ``OrdinalEncoder``   - the same for columns with many values: the rank of the value (unknown -> -1)
* ``DatetimeParts``    - year/month/day/hour columns, unparsed -> 0
* ``QuoteStrip``       - NULL -> '' and quote/space stripping of string columns
* ``LabelText``        - stripped image of a string target
* ``FiniteVector``     - non-finite vector slots -> 0
* ``SmoothTfidf``      - corpus-frequency vocabulary, idf = ln((1+n)/(1+df)) + 1, L2 rows
* ``FScoreSelector``   - keep the k best vector slots by ANOVA F / F-regression

Small fitted values live in params (lists), so ``DefaultParamsWritable`` stores them as JSON;
an ordinal dictionary is a DataFrame, saved as Parquet beside the params.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, PipelineModel, Transformer
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasInputCols, HasLabelCol, HasOutputCol, HasOutputCols
from pyspark.ml.util import (DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter,
                             MLReadable, MLReader, MLWritable, MLWriter)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import (base_family, finite_or_null, guarded_double, nonfinite_to_zero, parse_datetime,
                                 strip_label, strip_quotes_fill)
from ..functions.text import tokens, with_bigrams
from . import features as FE


class _Persist(DefaultParamsReadable, DefaultParamsWritable):
    pass


# ---- column recall, coercion, label text, finite vectors -----------------------------------

class KnownColumns(Transformer, HasInputCols, _Persist):
    """Columns the pipeline was trained on and a frame lacks are added as NULL strings; the
    imputing stages fill them.  Columns it does not know are left alone and never assembled."""

    @keyword_only
    def __init__(self, inputCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.lit(None).cast("string") for c in self.getInputCols() if c not in df.columns})


class NumericCoerce(Transformer, HasInputCols, HasOutputCols, _Persist):
    @keyword_only
    def __init__(self, inputCols=None, outputCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        def number(c):
            numeric = base_family(df.schema[c].dataType) in ("numeric", "boolean")
            return finite_or_null(F.col(c) if numeric else guarded_double(F.col(c).cast("string")))
        return df.withColumns({o: number(c) for c, o in zip(self.getInputCols(), self.getOutputCols())})


class LabelText(Transformer, HasInputCol, HasOutputCol, _Persist):
    @keyword_only
    def __init__(self, inputCol=None, outputCol=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        c = self.getInputCol()
        source = F.col(c).cast("string") if c in df.columns else F.lit(None).cast("string")
        return df.withColumn(self.getOutputCol(), strip_label(source))


class FiniteVector(Transformer, HasInputCol, HasOutputCol, _Persist):
    @keyword_only
    def __init__(self, inputCol=None, outputCol=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        slots = F.transform(vector_to_array(self.getInputCol()), nonfinite_to_zero)
        return df.withColumn(self.getOutputCol(), array_to_vector(slots))


def validate_numeric(df: DataFrame, columns: list[str]) -> None:
    """CLN15: every feature column is numeric, boolean or a vector of doubles, else TypeError."""
    from pyspark.ml.linalg import VectorUDT
    wrong = [f"{c}: {df.schema[c].dataType.simpleString()}" for c in columns
             if base_family(df.schema[c].dataType) not in ("numeric", "boolean")
             and not isinstance(df.schema[c].dataType, VectorUDT)]
    if wrong:
        raise TypeError("features must be numeric before training: " + ", ".join(wrong))


# ---- scaling -------------------------------------------------------------------------------

class _ScalerParams(HasInputCols, HasOutputCols):
    medians = Param(Params._dummy(), "medians", "fitted medians", TypeConverters.toListFloat)
    means = Param(Params._dummy(), "means", "fitted means", TypeConverters.toListFloat)
    stds = Param(Params._dummy(), "stds", "fitted population stds", TypeConverters.toListFloat)


class ExactScaler(Estimator, _ScalerParams, _Persist):
    @keyword_only
    def __init__(self, inputCols=None, outputCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "ExactScalerModel":
        cols = self.getInputCols()
        fit = FE.fit_standard_scaler(df, cols)
        return ExactScalerModel(inputCols=cols, outputCols=self.getOutputCols(),
                                medians=[float(fit.medians[c]) for c in cols],
                                means=[float(fit.means[c] or 0.0) for c in cols],
                                stds=[float(fit.stds[c] or 0.0) for c in cols])


class ExactScalerModel(Model, _ScalerParams, _Persist):
    @keyword_only
    def __init__(self, inputCols=None, outputCols=None, medians=None, means=None, stds=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        out = df
        for c, o, med, m, s in zip(self.getInputCols(), self.getOutputCols(), self.getOrDefault(self.medians),
                                   self.getOrDefault(self.means), self.getOrDefault(self.stds)):
            x = F.coalesce(finite_or_null(F.col(c)), F.lit(med))
            out = out.withColumn(o, (x - F.lit(m)) / F.lit(s) if s > 0 else x - F.lit(m))
        return out


# ---- categories ----------------------------------------------------------------------------

class _CatParams(HasInputCol, HasOutputCol):
    labels = Param(Params._dummy(), "labels", "sorted categories", TypeConverters.toListString)
    fill = Param(Params._dummy(), "fill", "imputed value", TypeConverters.toString)


class CategoryEncoder(Estimator, _CatParams, _Persist):
    """One-hot encoder for columns of few categories (see ``MAX_OHE_CATEGORIES``)."""

    @keyword_only
    def __init__(self, inputCol=None, outputCol=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "CategoryEncoderModel":
        c = self.getInputCol()
        text = df.select(strip_label(F.col(c).cast("string")).alias(c))
        fill = FE.category_modes(text, [c]).get(c) or ""
        labels = FE.fit_categories(text.fillna(fill, [c]), [c]).get(c, [])
        return CategoryEncoderModel(inputCol=c, outputCol=self.getOutputCol(), labels=labels, fill=fill)


class CategoryEncoderModel(Model, _CatParams, _Persist):
    @keyword_only
    def __init__(self, inputCol=None, outputCol=None, labels=None, fill=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        labels = self.getOrDefault(self.labels)
        v = F.coalesce(strip_label(F.col(self.getInputCol()).cast("string")), F.lit(self.getOrDefault(self.fill)))
        lab = F.array(*[F.lit(x) for x in labels]) if labels else F.array().cast("array<string>")
        pos = F.array_position(lab, v)               # 1-based, 0 when unseen
        onehot = F.transform(F.sequence(F.lit(1), F.lit(max(len(labels), 1))),
                             lambda i: F.when(i == pos, 1.0).otherwise(0.0))
        if not labels:
            onehot = F.array(F.lit(0.0))
        return df.withColumn(self.getOutputCol(), array_to_vector(onehot))


class OrdinalEncoder(Estimator, HasInputCol, HasOutputCol, _Persist):
    """Rank of a category among the training categories, for columns of any number of values:
    the dictionary is ranked by Spark, stays a DataFrame and is joined."""

    @keyword_only
    def __init__(self, inputCol=None, outputCol=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "OrdinalEncoderModel":
        c = self.getInputCol()
        text = df.select(strip_label(F.col(c).cast("string")).alias(c))
        fill = FE.category_modes(text, [c]).get(c) or ""
        model = OrdinalEncoderModel(inputCol=c, outputCol=self.getOutputCol(), fill=fill)
        model.dictionary = FE.fit_ordinal(text, c, fill).checkpoint()
        return model


class OrdinalEncoderModel(Model, HasInputCol, HasOutputCol, MLWritable, MLReadable):
    fill = Param(Params._dummy(), "fill", "imputed value", TypeConverters.toString)
    dictionary: DataFrame       # (__v, __code)

    @keyword_only
    def __init__(self, inputCol=None, outputCol=None, fill=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def copy(self, extra=None):
        new = super().copy(extra)
        new.dictionary = self.dictionary
        return new

    def _transform(self, df: DataFrame) -> DataFrame:
        value = F.coalesce(strip_label(F.col(self.getInputCol()).cast("string")), F.lit(self.getOrDefault(self.fill)))
        joined = df.withColumn("__v", value).join(self.dictionary, "__v", "left")
        return joined.withColumn(self.getOutputCol(), F.coalesce(F.col("__code"), F.lit(-1)).cast("double")).drop("__v", "__code")

    def write(self) -> MLWriter:
        return _DictionaryWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _DictionaryReader()


class _DictionaryWriter(MLWriter):
    def __init__(self, instance: OrdinalEncoderModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        self.instance.dictionary.write.parquet(f"{path}/dictionary")


class _DictionaryReader(MLReader):
    def load(self, path: str) -> OrdinalEncoderModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = OrdinalEncoderModel()
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        model.dictionary = self.sparkSession.read.parquet(f"{path}/dictionary")
        return model


# ---- datetime parts / quote strip ---------------------------------------------------------

class DatetimeParts(Transformer, HasInputCols, _Persist):
    @keyword_only
    def __init__(self, inputCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        out = df
        for c in self.getInputCols():
            if c not in df.columns:
                continue
            t = df.schema[c].dataType.typeName()
            ts = F.col(c) if t in ("timestamp", "timestamp_ntz", "date") else parse_datetime(F.col(c).cast("string"))
            for part, fn in (("year", F.year), ("month", F.month), ("day", F.dayofmonth), ("hour", F.hour)):
                out = out.withColumn(f"{c}_{part}", F.coalesce(fn(ts), F.lit(0)))
        return out


class QuoteStrip(Transformer, HasInputCols, _Persist):
    @keyword_only
    def __init__(self, inputCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        out = df
        for c in self.getInputCols():
            if c in df.columns:
                out = out.withColumn(c, strip_quotes_fill(F.col(c)))
        return out


# ---- TF-IDF --------------------------------------------------------------------------------

class _TfidfParams(HasInputCol, HasOutputCol):
    maxFeatures = Param(Params._dummy(), "maxFeatures", "vocabulary size", TypeConverters.toInt)
    vocabulary = Param(Params._dummy(), "vocabulary", "terms", TypeConverters.toListString)
    idf = Param(Params._dummy(), "idf", "idf per term", TypeConverters.toListFloat)


class SmoothTfidf(Estimator, _TfidfParams, _Persist):
    @keyword_only
    def __init__(self, inputCol=None, outputCol=None, maxFeatures=200):
        super().__init__()
        self._setDefault(maxFeatures=200)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "SmoothTfidfModel":
        from . import tfidf as TF
        docs = df.select(F.monotonically_increasing_id().alias("_doc"), F.col(self.getInputCol()).alias("_t"))
        vocab = TF.fit_vocabulary(docs, "_doc", "_t", self.getOrDefault(self.maxFeatures)).orderBy("term").collect()
        return SmoothTfidfModel(inputCol=self.getInputCol(), outputCol=self.getOutputCol(),
                                vocabulary=[r["term"] for r in vocab], idf=[float(r["idf"]) for r in vocab])


class SmoothTfidfModel(Model, _TfidfParams, _Persist):
    @keyword_only
    def __init__(self, inputCol=None, outputCol=None, vocabulary=None, idf=None, maxFeatures=200):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        vocab = self.getOrDefault(self.vocabulary)
        idf = self.getOrDefault(self.idf)
        if not vocab:
            return df.withColumn(self.getOutputCol(), array_to_vector(F.array(F.lit(0.0))))
        # one look-up per term of a row, whatever the size of the vocabulary
        terms = F.coalesce(with_bigrams(tokens(F.col(self.getInputCol()))), F.array().cast("array<string>"))
        stages = [CountVectorizerModel.from_vocabulary(vocab, inputCol="__terms", outputCol="__counts"),
                  ElementwiseProduct(scalingVec=Vectors.dense(idf), inputCol="__counts", outputCol="__weights"),
                  Normalizer(p=2.0, inputCol="__weights", outputCol=self.getOutputCol())]
        return PipelineModel(stages=stages).transform(df.withColumn("__terms", terms)).drop("__terms", "__counts", "__weights")


# ---- F-score selection ---------------------------------------------------------------------

class _SelParams(HasInputCol, HasOutputCol, HasLabelCol):
    k = Param(Params._dummy(), "k", "slots kept", TypeConverters.toInt)
    task = Param(Params._dummy(), "task", "classification or regression", TypeConverters.toString)
    indices = Param(Params._dummy(), "indices", "kept slots", TypeConverters.toListInt)


class FScoreSelector(Estimator, _SelParams, _Persist):
    @keyword_only
    def __init__(self, inputCol=None, outputCol=None, labelCol="label", k=500, task="classification"):
        super().__init__()
        self._setDefault(k=500, task="classification", labelCol="label")
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "FScoreSelectorModel":
        from . import select as SEL
        arr = df.select(vector_to_array(self.getInputCol()).alias("_a"), self.getLabelCol())
        n = len(arr.first()["_a"])
        k = self.getOrDefault(self.k)
        if n <= k:
            idx = list(range(n))
        else:
            wide = arr.select(self.getLabelCol(), *[F.col("_a")[i].alias(f"f{i}") for i in range(n)])
            feats = [f"f{i}" for i in range(n)]
            sc = (SEL.f_classif(wide, feats, self.getLabelCol()) if self.getOrDefault(self.task) == "classification"
                  else SEL.f_regression(wide, feats, self.getLabelCol()))
            idx = sorted(r["position"] for r in SEL.select_k_best(sc, k).where("selected").collect())
        return FScoreSelectorModel(inputCol=self.getInputCol(), outputCol=self.getOutputCol(), indices=idx)


class FScoreSelectorModel(Model, _SelParams, _Persist):
    @keyword_only
    def __init__(self, inputCol=None, outputCol=None, indices=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        from pyspark.ml.feature import VectorSlicer
        return VectorSlicer(inputCol=self.getInputCol(), outputCol=self.getOutputCol(),
                            indices=self.getOrDefault(self.indices)).transform(df)
