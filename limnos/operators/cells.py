"""Trees over cells: rows that agree in class, weight and all bins are one point with their count.

Spark's trees read a number only through its bin (about 32 a feature), so after binning they cannot tell such rows apart.
A cell stands for its rows with what each tree drew of them, and the passes of all levels are over the cells: there are no
more of them than combinations of bins, however many rows there are.  Bins, draws and choices of features are Spark's own,
made over the rows with the estimator's seed as in a plain fit.  The trees are those of a plain fit up to the rounding of
sums: a cell's weight is one product where the rows' weights are added one by one.  Where cells are not fewer than half the
rows they save little, and the plain fit is made.

The bins and draws are reached through the JVM classes that Spark's own estimators call (`ml.tree.impl`).
"""

from __future__ import annotations

import math
import sys

from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import Bucketizer, ImputerModel, StringIndexerModel, VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FEWER = 0.5  # of the rows: with more cells than that the plain fit is made
TOGETHER = 4  # forests that share the cores
PART = 100_000  # cells of a partition at most
_IMPL = "org.apache.spark.ml.tree.impl."
_ENCODERS = "org.apache.spark.sql.catalyst.encoders.AgnosticEncoders$"


def _class(spark: SparkSession, name: str):
    return spark._jvm.java.lang.Class.forName(name)


def _object(spark: SparkSession, name: str):
    return _class(spark, name + "$").getField("MODULE$").get(None)


class _Encoders:
    """Spark's encoders between data frames and the points that its tree trainer reads."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        double, ints = _object(spark, _ENCODERS + "PrimitiveDoubleEncoder"), self._new("ArrayEncoder", _object(spark, _ENCODERS + "PrimitiveIntEncoder"), False)
        udt = spark._jvm.org.apache.spark.ml.linalg.VectorUDT()
        vector = self._new("UDTEncoder", udt, udt.getClass())
        self.instance = self._product("org.apache.spark.ml.feature.Instance", label=double, weight=double, features=vector)
        tree_point = self._product(_IMPL + "TreePoint", label=double, binnedFeatures=ints, weight=double)
        self.bagged = self._product(_IMPL + "BaggedPoint", datum=tree_point, subsampleCounts=ints, sampleWeight=double)

    def _new(self, name: str, *args):
        values = self.spark.sparkContext._gateway.new_array(self.spark._jvm.java.lang.Object, len(args))
        for i, x in enumerate(args):
            values[i] = x
        return _class(self.spark, _ENCODERS + name).getConstructors()[0].newInstance(values)

    def _product(self, name: str, **fields):
        jvm, found = self.spark._jvm, self.spark._jvm.java.util.ArrayList()
        none, plain = jvm.scala.Option.empty(), jvm.org.apache.spark.sql.types.Metadata.empty()
        for field, encoder in fields.items():
            found.add(self._new("EncoderField", field, encoder, False, plain, none, none))
        return self._new("ProductEncoder", jvm.scala.reflect.ClassTag.apply(_class(self.spark, name)), jvm.org.apache.spark.api.python.PythonUtils.toSeq(found), none)

    @staticmethod
    def points(df: DataFrame, encoder):
        """The rows of `df`, in their partitions and order, as an RDD of the encoder's class."""
        return getattr(df._jdf, "as")(encoder).rdd()

    def frame(self, points, encoder) -> DataFrame:
        return DataFrame(self.spark._jsparkSession.createDataset(points, encoder).toDF(), self.spark)


class _Training:
    """What a plain fit of the forest `est` makes of `rows` before its first tree: instances, their description and the splits."""

    def __init__(self, rows: DataFrame, est: RandomForestClassifier):
        self.spark, self.encoders = rows.sparkSession, _Encoders(rows.sparkSession)
        weight = F.col(est.getWeightCol()).cast("double") if est.isDefined("weightCol") else F.lit(1.0)
        self.instances = _Encoders.points(rows.select(F.col(est.getLabelCol()).cast("double").alias("label"), weight.alias("weight"),
                                                      F.col(est.getFeaturesCol()).alias("features")), self.encoders.instance)
        self.nominal = self.spark._jvm.org.apache.spark.ml.util.MetadataUtils.getCategoricalFeatures(rows._jdf.schema().apply(est.getFeaturesCol()))
        strategy, j = self.strategy(est), est._java_obj
        self.metadata = self.spark._jvm.org.apache.spark.ml.tree.impl.DecisionTreeMetadata.buildMetadata(self.instances, strategy, j.getNumTrees(), j.getFeatureSubsetStrategy())
        self.splits = _object(self.spark, _IMPL + "RandomForest").findSplits(self.instances, self.metadata, j.getSeed())

    def strategy(self, est: RandomForestClassifier):
        """The trainer's form of the parameters of `est`, for two classes."""
        est._transfer_params_to_java()
        j = est._java_obj
        made = j.getOldStrategy(self.nominal, 2, self.spark._jvm.org.apache.spark.mllib.tree.configuration.Algo.Classification(), j.getOldImpurity(), j.getSubsamplingRate())
        getattr(made, "bootstrap_$eq")(j.getBootstrap())
        return made

    def described(self, strategy):
        """The description of the instances for trees of this strategy; bins and number of trees stay."""
        m = self.metadata
        return self.spark._jvm.org.apache.spark.ml.tree.impl.DecisionTreeMetadata(
            m.numFeatures(), m.numExamples(), m.weightedNumExamples(), m.numClasses(), m.maxBins(), m.featureArity(), m.unorderedFeatures(), m.numBins(), m.impurity(),
            m.quantileStrategy(), strategy.maxDepth(), strategy.minInstancesPerNode(), m.minWeightPerNode(), strategy.minInfoGain(), m.numTrees(), m.numFeaturesPerNode())

    def thresholds(self, feature: int) -> list[float]:
        return [s.threshold() for s in self.splits[feature]]


# ---------------------------------------------------------------------------
# Forests
# ---------------------------------------------------------------------------

class BaggedCells:
    """The cells of `rows` with what `est.getNumTrees()` trees drew of each, kept for all forests of that number of trees."""

    def __init__(self, rows: DataFrame, est: RandomForestClassifier):
        self.trees, t = est.getNumTrees(), _Training(rows, est)
        self.training, jvm = t, t.spark._jvm
        binned = jvm.org.apache.spark.ml.tree.impl.TreePoint.convertToTreeRDD(t.instances, t.splits, t.metadata)
        bagging = _object(t.spark, _IMPL + "BaggedPoint")
        drawn = bagging.convertToBaggedRDD(binned, est.getSubsamplingRate(), self.trees, est.getBootstrap(), getattr(bagging, "convertToBaggedRDD$default$5")(), est.getSeed())
        each = [F.sum(F.get("subsampleCounts", F.lit(i))).cast("int") for i in range(self.trees)]
        self.frame = t.encoders.frame(drawn, t.encoders.bagged).groupBy("datum").agg(F.array(*each).alias("subsampleCounts")).select(
            "datum", "subsampleCounts", F.col("datum.weight").alias("sampleWeight")).persist(StorageLevel.MEMORY_AND_DISK)
        self.count = self.frame.count()
        self.fewer = self.count < FEWER * t.metadata.numExamples()
        self.points = None
        if self.fewer:
            # few partitions, as every one sends statistics of all nodes of a level, and forests are grown several at a time
            parts = max(1, t.spark.sparkContext.defaultParallelism // TOGETHER, -(-self.count // PART))
            self.points = _Encoders.points(self.frame.coalesce(parts), t.encoders.bagged).persist(jvm.org.apache.spark.storage.StorageLevel.MEMORY_AND_DISK())
            self.points.count()
        self.frame.unpersist()

    def unpersist(self) -> None:
        if self.points is not None:
            self.points.unpersist(False)


class CellForest(RandomForestClassifier):
    """A forest that is grown over the cells it is given (`cells`), where they are fewer than half the rows."""

    cells: BaggedCells | None = None

    @staticmethod
    def like(est: RandomForestClassifier) -> CellForest:
        return est._copyValues(CellForest())

    def over(self, cells: BaggedCells | None) -> CellForest:
        forest = self.copy()
        forest.cells = cells
        return forest

    def _fit(self, dataset: DataFrame):
        if self.cells is None or not self.cells.fewer:
            return super()._fit(dataset)
        t, jvm = self.cells.training, self.cells.training.spark._jvm
        strategy = t.strategy(self)
        context, none = t.spark.sparkContext, jvm.scala.Option.empty()
        splits = context._jsc.sc().broadcast(t.splits, jvm.scala.reflect.ClassTag.apply(_class(t.spark, "[[Lorg.apache.spark.ml.tree.Split;")))
        try:
            grown = jvm.org.apache.spark.ml.tree.impl.RandomForest.runBagged(
                self.cells.points, t.described(strategy), splits, strategy, self.getNumTrees(), self.getFeatureSubsetStrategy(), self.getSeed(), none, True, none, 0)
        finally:
            splits.destroy()
        trees = context._gateway.new_array(jvm.org.apache.spark.ml.classification.DecisionTreeClassificationModel, len(grown))
        for i, tree in enumerate(grown):
            trees[i] = tree
        forest = jvm.org.apache.spark.ml.classification.RandomForestClassificationModel(self._java_obj.uid(), trees, t.metadata.numFeatures(), 2)
        model = self._copyValues(self._create_model(forest))
        model._transfer_params_to_java()
        return model


# ---------------------------------------------------------------------------
# Boosted trees
# ---------------------------------------------------------------------------

class Cells:
    """Stages of a fitted preparation (`ml.preprocess`, not scaled) with a binning of its numbers, after which rows can be counted by cell.

    front: up to the imputed numbers and the index of each category; back: from there on to the vector `cells`, in which a
    number is that of its bin."""

    def __init__(self, stages):
        self.front = [s for s in stages if isinstance(s, ImputerModel | StringIndexerModel)]
        assembler = next(s for s in stages if isinstance(s, VectorAssembler))
        self.plain = [*(s for s in stages[:stages.index(assembler)] if s not in self.front), assembler]
        self.numbers = [c for s in self.front if isinstance(s, ImputerModel) for c in s.getOutputCols()]
        self.codes = [c for s in self.front if isinstance(s, StringIndexerModel) for c in s.getOutputCols()]
        self.bins = [f"{c}__bin" for c in self.numbers]
        self.bucketizer, self.back = None, []

    def kept(self, df: DataFrame, *others: str) -> DataFrame:
        """What tells the rows' cells, a few numbers a row."""
        return PipelineModel(self.front).transform(df).select("target", *others, *self.numbers, *self.codes)

    def vectors(self, kept: DataFrame) -> DataFrame:
        return PipelineModel(self.plain).transform(kept)

    def bin(self, kept: DataFrame, est) -> Cells:
        """Take the bins that a plain fit of the trees `est` finds in these rows."""
        return self.bin_like(_Training(self.vectors(kept), RandomForestClassifier(
            featuresCol=self.plain[-1].getOutputCol(), labelCol="target", maxBins=est.getMaxBins(), seed=est.getSeed())))

    def bin_like(self, training: _Training) -> Cells:
        # a bucket has its lower bound, a bin its threshold as the largest value; a number without a threshold has one bin
        bounds = [[-math.inf, *(math.nextafter(x, math.inf) for x in training.thresholds(i) or [sys.float_info.max]), math.inf] for i in range(len(self.numbers))]
        if self.numbers:
            self.bucketizer = Bucketizer(splitsArray=bounds, inputCols=self.numbers, outputCols=self.bins, handleInvalid="keep")
        self.back = [*self.plain[:-1], VectorAssembler(inputCols=[*self.bins, *self.plain[-1].getInputCols()[len(self.bins):]], outputCol="cells", handleInvalid="keep")]
        return self

    def counted(self, kept: DataFrame, *others: str) -> DataFrame:
        """(target, others, cells, n): a row a cell.  The bins are numbers in order: without the bucketizer's attributes, by which
        trees would take them for categories."""
        found = self._groups(kept, *others)
        found = found.select("target", *others, "n", *self.codes, *[F.col(b).alias(b, metadata={}) for b in self.bins])
        return PipelineModel(self.back).transform(found).select("target", *others, "n", "cells")

    def examples(self, kept: DataFrame) -> DataFrame:
        """(target, n, vector of the plain preparation): a row a cell, for models whose splits are bounds of these bins."""
        return self.vectors(self._groups(kept)).select("target", "n", self.plain[-1].getOutputCol())

    def _groups(self, kept: DataFrame, *others: str) -> DataFrame:
        binned = self.bucketizer.transform(kept) if self.bucketizer else kept
        return binned.groupBy("target", *others, *self.bins, *self.codes).agg(F.count(F.lit(1)).cast("double").alias("n"), *[F.min(c).alias(c) for c in self.numbers])

    def stages(self) -> list:
        """Stages from rows to the vector of their cells."""
        return [*self.front, *([self.bucketizer] if self.bucketizer else []), *self.back]


def on_cells(est, cells: int) -> dict:
    """The parameters by which the boosted trees `est` train on so many counted cells.  Every bin stays a candidate for a split: none is
    lost to the sample that a fit takes of more than maxBins * maxBins rows."""
    return {est.featuresCol: "cells", est.weightCol: "n", est.maxBins: max(2 * est.getMaxBins(), math.isqrt(cells) + 1)}
