"""Time splits, features, models and their evaluation."""

from __future__ import annotations

import json
import math
import uuid

from pyspark.ml.feature import Interaction, OneHotEncoder, StringIndexer, VectorAssembler, VectorSizeHint
from pyspark.ml.classification import FMClassifier, LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from skirmish.functions import estimators as est
from skirmish.functions import text as tx
from skirmish.operators import rates as rt
from skirmish.operators.discovery import checkpointed, shared_folder

CS = (0.001, 0.01, 0.1, 1.0, 10.0)


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """df with its place (from 0) in a total order: sorted by ranges, with the sizes of the ranges before added.

    The sorted rows and their places inside a range are written once (a checkpoint in the shared folder), so the
    sizes and the rows are of the same ranges. No task gets more than its range; the sizes are one row for each.
    """
    own = F.monotonically_increasing_id()  # the range in the upper bits, the place inside it in the lower 33
    ranged = checkpointed(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", own)).withColumn("_part", F.shiftright("_at", 33))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    place = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return ranged.join(F.broadcast(before), "_part").withColumn("place", place).drop("_part", "_at", "_before")


def reached(df: DataFrame, n: int, order: list[str], places: list[int]) -> list[Column]:
    """For each of the places in the order of n rows, whether a row of df is there or later.

    Only the order's columns are sorted; one row for each place goes to the driver. Rows that are equal in all of the
    order's columns fall on the same side.
    """
    inside = sorted({p for p in places if 0 < p < n})
    keys = numbered(df.select(*order), order).where(F.col("place").isin(inside)).collect() if inside else []
    at = {r["place"]: F.struct(*[F.lit(r[c]).cast(df.schema[c].dataType).alias(c) for c in order]) for r in keys}
    return [F.lit(p <= 0) if p not in at else F.struct(*order) >= at[p] for p in places]


def time_split(df: DataFrame, val: float = 0.15, test: float = 0.15, order: tuple[str, ...] = ("created_ms", "game_id")) -> DataFrame:
    """Adds split: the last rows in time are test, those before them val (one row at least), the rest train.

    The two borders are exact places in the order; rows are compared with the keys there and aren't shuffled.
    """
    n = df.count()
    n_val, n_test = max(1, int(n * val)), max(1, int(n * test))
    in_test, in_val = reached(df, n, list(order), [n - n_test, n - n_test - n_val])
    return df.withColumn("split", F.when(in_test, "test").when(in_val, "val").otherwise("train"))


def version_time_split(df: DataFrame, old: list[str], new: str, part: float = 0.70) -> DataFrame:
    """All of the old versions and the first part of the new one train; half of the rest is val, half test."""
    minor = tx.truncate_version(F.col("patch"), 2)
    late = df.where(minor == new)
    n = late.count()
    a = int(n * part)
    in_val, in_test = reached(late, n, ["created_ms", "game_id"], [a, a + (n - a) // 2])
    split = F.when(minor.isin(old) | ~in_val, "train").when(~in_test, "val").otherwise("test")
    return df.where((minor == new) | minor.isin(old)).withColumn("split", split)


def expanding_folds(df: DataFrame, k: int = 5) -> DataFrame:
    """(fold, part, row): for fold i the first i blocks of time train and the next one tests."""
    n = df.count()
    starts = reached(df, n, ["created_ms", "game_id"], [-(-b * n // (k + 1)) for b in range(1, k + 1)])
    rows = df.withColumn("block", sum((x.cast("int") for x in starts), F.lit(0)))
    folds = F.explode(F.sequence(F.greatest(F.col("block"), F.lit(1)), F.lit(k)))
    return rows.withColumn("fold", folds).withColumn("part", F.when(F.col("block") == F.col("fold"), "test").otherwise("train"))


def split_base_rate(df: DataFrame) -> DataFrame:
    return df.groupBy("split").agg(F.count("*").alias("n"), F.round(F.avg(F.col("blue_wins").cast("double")), 6).alias("base_rate"))


def split_version_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("split", tx.truncate_version(F.col("patch"), 2).alias("version")).agg(F.count("*").alias("n"))


def build_vocab(df: DataFrame, arrays: tuple[str, ...] = ("blue", "red")) -> DataFrame:
    """(entity_id, index): distinct entities in order. The table of entities is small: one row for each."""
    ids = df.select(F.explode(F.array_distinct(F.concat(*arrays))).alias("entity_id")).distinct()
    return ids.withColumn("index", F.row_number().over(Window.orderBy("entity_id")) - 1)


def known_only(train: DataFrame, other: DataFrame) -> DataFrame:
    """Rows of other whose entities all occur in train."""
    from skirmish.operators.matches import all_known

    return all_known(other, ["blue", "red"], build_vocab(train).select("entity_id"))


def _dense(vocab: list[int], value) -> Column:
    return array_to_vector(F.array(*[value(v).cast("double") for v in vocab]))


def two_team_features(df: DataFrame, vocab: list[int]) -> DataFrame:
    """+1 for each blue and -1 for each red entity of the vocabulary."""
    has = lambda c, v: F.array_contains(c, F.lit(v).cast("long")).cast("int")
    return df.withColumn("features", _dense(vocab, lambda v: has("blue", v) - has("red", v)))


def solo_features(df: DataFrame, vocab: list[int]) -> DataFrame:
    return df.withColumn("features", _dense(vocab, lambda v: F.array_contains("team", F.lit(v).cast("long")).cast("int")))


def place_of(entity: Column, vocab: list[int]) -> Column:
    """The entity's place in the vocabulary, null if it has none: a table of short lists by the id's remainder, as a literal.

    The vocabulary is on the driver, as a model's coefficients are: a number for each entity.
    """
    size = max(1, 2 * len(vocab))
    table: list[list[tuple[int, int]]] = [[] for _ in range(size)]
    for place, v in enumerate(vocab):
        table[v % size].append((v, place))
    kind = "array<array<struct<id:bigint,place:int>>>"
    held = F.from_json(F.lit(json.dumps([[{"id": v, "place": p} for v, p in some] for some in table])), kind)  # folded once, not for each row
    some = F.get(held, F.pmod(entity, F.lit(size)).cast("int"))
    return F.get(F.filter(some, lambda x: x["id"] == entity), F.lit(0))["place"]


def _known(places: Column) -> Column:
    return F.filter(places, lambda x: x.isNotNull())


def two_team_places(df: DataFrame, vocab: list[int], name: str = "sparse") -> DataFrame:
    """Adds an array of (place, value) in order: how often an entity is on the blue side, less how often on the red."""
    rows = df.withColumn("_blue", _known(F.transform("blue", lambda e: place_of(e, vocab)))).withColumn("_red", _known(F.transform("red", lambda e: place_of(e, vocab))))
    times = lambda side, i: F.size(F.filter(side, lambda x: x == i))
    each = F.transform(F.array_sort(F.array_distinct(F.concat("_blue", "_red"))), lambda i: F.struct(i.alias("place"), (times("_blue", i) - times("_red", i)).cast("double").alias("value")))
    return rows.withColumn(name, F.filter(each, lambda x: x["value"] != 0)).drop("_blue", "_red")


def team_places(df: DataFrame, vocab: list[int], pairs: bool = False, name: str = "sparse") -> DataFrame:
    """Adds an array of (place, 1) in order: the team's entities, and with ``pairs`` its pairs in the places after all entities."""
    own = df.withColumn("_own", F.array_sort(F.array_distinct(_known(F.transform("team", lambda e: place_of(e, vocab))))))
    both = F.transform(rt.unordered_pairs(F.col("_own")), lambda p: pair_index(p["a"].cast("long"), p["b"].cast("long"), len(vocab)).cast("int"))
    places = F.concat("_own", F.array_sort(both)) if pairs else F.col("_own")
    return own.withColumn(name, F.transform(places, lambda i: F.struct(i.alias("place"), F.lit(1.0).alias("value")))).drop("_own")


def sparse_width(n: int, pairs: bool = False) -> int:
    return n + n * (n - 1) // 2 * pairs


def as_vectors(df: DataFrame, width: int, name: str = "sparse", features: str = "features") -> DataFrame:
    """df with sparse vectors of ``width`` instead of arrays (place, value), written once to the shared folder.

    A file holds a vector as its parts; read with the vector's type they are vectors, so none is built dense and no Python runs.
    """
    spark, place = df.sparkSession, f"{shared_folder(df.sparkSession)}/features-{uuid.uuid4()}"
    parts = F.struct(F.lit(0).cast("tinyint").alias("type"), F.lit(width).alias("size"), F.col(f"{name}.place").cast("array<int>").alias("indices"), F.col(f"{name}.value").alias("values"))
    rows = df.withColumn(features, parts).drop(name)
    rows.write.parquet(place)
    kind = StructType([StructField(f.name, VectorUDT() if f.name == features else f.dataType) for f in rows.schema])
    return spark.read.schema(kind).parquet(place)


def pair_index(a: Column, b: Column, n: int) -> Column:
    """Place of the pair of places a < b after n single ones, the upper triangle row by row."""
    return F.lit(n) + a * n - F.floor(a * (a + 1) / 2) + (b - a - 1)


def solo_pair_features(df: DataFrame, vocab: DataFrame, n: int, key: str = "game_id") -> DataFrame:
    """Places that are set, of n entities and their pairs, as a sorted array (the sparse form)."""
    rows = df.select(key, "y", F.explode("team").alias("entity_id")).join(F.broadcast(vocab), "entity_id")
    teams = rows.groupBy(key, "y").agg(F.array_sort(F.collect_list(F.col("index").cast("long"))).alias("singles"))
    pairs = F.transform(rt.unordered_pairs(F.col("singles")), lambda p: pair_index(p["a"], p["b"], n).cast("long"))
    return teams.withColumn("places", F.array_sort(F.concat("singles", pairs)))


def fit_lr(train: DataFrame, label: str = "label", c: float = 1.0, n: int | None = None):
    """Logistic regression of strength c as 1 / (c n) of the mean loss, without standardising."""
    n = n or train.count()
    return LogisticRegression(featuresCol="features", labelCol=label, regParam=1 / (c * n), elasticNetParam=0.0, standardization=False, maxIter=60).fit(train)


def version_features(train: DataFrame, rows: DataFrame, size: int, version: str = "version", features: str = "features") -> DataFrame:
    """rows whose features are followed by those of their version alone: one block for each version of train.

    A version that train hasn't leaves its block empty, so such rows are scored by the common part.
    """
    index = StringIndexer(inputCol=version, outputCol="_index", handleInvalid="keep").fit(train)
    hot = OneHotEncoder(inputCol="_index", outputCol="_hot", dropLast=True).fit(index.transform(train))
    sized = VectorAssembler(inputCols=[features], outputCol="_sized")
    own = Interaction(inputCols=["_hot", "_sized"], outputCol="_own")
    both = VectorAssembler(inputCols=["_sized", "_own"], outputCol="_both")
    rows = VectorSizeHint(inputCol=features, size=size).transform(hot.transform(index.transform(rows)))
    found = both.transform(own.transform(sized.transform(rows)))
    return found.drop(features, "_index", "_hot", "_sized", "_own").withColumnRenamed("_both", features)


def predicted(model, df: DataFrame) -> DataFrame:
    return model.transform(df).withColumn("p", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")


def sweep_lr(train: DataFrame, val: DataFrame, cs: tuple[float, ...] = CS, label: str = "label") -> tuple[object, float]:
    """The model of least log-loss on val over the strengths."""
    n = train.count()
    tried = [(binary_metrics(predicted(m := fit_lr(train, label, c, n), val), label, "p").first()["log_loss"], c, m) for c in cs]
    best = min(tried, key=lambda t: t[:2])
    return best[2], best[1]


def fit_fm(train: DataFrame, label: str = "label", factors: int = 4, seed: int = 7):
    """Factorisation machine over the same features: pair interactions without order; stands in for a set model."""
    return FMClassifier(featuresCol="features", labelCol=label, factorSize=factors, maxIter=40, stepSize=0.05, seed=seed).fit(train)


def fit_stacked(train: DataFrame, base, extra: list[str], label: str = "label"):
    """A second model over the first one's logit and further columns."""
    return fit_lr(stacked_features(predicted(base, train), extra), label)


def stacked_features(scored: DataFrame, extra: list[str]) -> DataFrame:
    return scored.withColumn("features", array_to_vector(F.array(est.logit("p", 1e-6), *[F.col(c).cast("double") for c in extra])))


def binary_metrics(df: DataFrame, label: str, prob: str, *by: str) -> DataFrame:
    """n, log-loss (clipped at 1e-7), accuracy at a half, Brier score, and the constant's log-loss."""
    p, y = est.clip(prob, 1e-7, 1 - 1e-7), est.number(label)
    rows = df.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(-(y * F.log(p) + (1 - y) * F.log(1 - p))).alias("log_loss"), F.avg(((est.number(prob) >= 0.5) == (y == 1)).cast("double")).alias("accuracy"),
        F.avg(F.pow(est.number(prob) - y, 2)).alias("brier"), F.avg(y).alias("_b"),
    )
    b = est.clip("_b", 1e-7, 1 - 1e-7)
    return rows.withColumn("constant_log_loss", -(F.col("_b") * F.log(b) + (1 - F.col("_b")) * F.log(1 - b))).drop("_b")


def calibration(df: DataFrame, label: str, prob: str, bins: int = 10, close_last: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """Bins [low, high) of probabilities with mean probability and rate; 1 falls in no bin unless the last is closed."""
    p = est.number(prob)
    b = F.floor(p * bins)
    b = F.when(p == 1, bins - 1).otherwise(b) if close_last else b
    rows = df.select(*by, b.cast("int").alias("bin"), p.alias("p"), est.number(label).alias("y")).where((F.col("bin") >= 0) & (F.col("bin") < bins))
    return rows.groupBy(*by, "bin").agg(F.count("*").alias("n"), F.avg("p").alias("confidence"), F.avg("y").alias("rate"))


def calibration_error(df: DataFrame, label: str, prob: str, bins: int = 10, close_last: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """Expected calibration error: mean gap of the bins, weighted by their share of all rows."""
    n = df.groupBy(*by).agg(F.count("*").alias("_n"))
    gaps = calibration(df, label, prob, bins, close_last, by).groupBy(*by).agg(F.sum(F.col("n") * F.abs(F.col("confidence") - F.col("rate"))).alias("_g"))
    rows = n.join(gaps, list(by), "left") if by else n.crossJoin(F.broadcast(gaps))
    return rows.select(*by, F.coalesce(F.col("_g") / F.col("_n"), F.lit(0.0)).alias("ece"))


def fit_temperature(df: DataFrame, label: str, logit: str, low: float = 0.05, high: float = 20.0, steps: int = 25, rounds: int = 3) -> float:
    """Temperature of least log-loss; each round is one pass with all temperatures side by side."""
    best = 1.0
    for _ in range(rounds):
        ts = [low * (high / low) ** (i / (steps - 1)) for i in range(steps)]
        y, z = est.number(label), est.number(logit)
        loss = lambda t: F.avg(F.log(1 + F.exp(-F.abs(z / max(t, 0.01)))) + F.greatest(z / max(t, 0.01), F.lit(0.0)) - y * z / max(t, 0.01))
        found = df.agg(*[loss(t).alias(f"l{i}") for i, t in enumerate(ts)]).first()
        if found[0] is None:
            return best
        best = ts[min(range(steps), key=lambda i: found[i])]
        step = math.log(high / low) / (steps - 1)
        low, high = best * math.exp(-step), best * math.exp(step)
    return best


def swap_augment(df: DataFrame, seed: int = 0) -> DataFrame:
    """About half of the rows, by a hash of id and seed, with sides and label turned round."""
    turn = F.pmod(F.xxhash64("game_id", F.lit(seed)), F.lit(2)) == 1
    return df.withColumns({"blue": F.when(turn, F.col("red")).otherwise(F.col("blue")), "red": F.when(turn, F.col("blue")).otherwise(F.col("red")), "blue_wins": F.when(turn, 1 - F.col("blue_wins")).otherwise(F.col("blue_wins"))})


def evaluation_table(scored: DataFrame, label: str = "label") -> DataFrame:
    """Metrics and calibration error for each (split, model) of (split, model, p, label)."""
    return binary_metrics(scored, label, "p", "split", "model").join(calibration_error(scored, label, "p", by=("split", "model")), ["split", "model"])


def choose_model(evaluations: DataFrame) -> DataFrame:
    return evaluations.where("split = 'val'").agg(F.max_by("model", F.struct("accuracy", -F.col("log_loss"), "model")).alias("model"))


def run_summary(evaluations: DataFrame, n_entities: int, versions: list[str], base_rate: float, temperature: float) -> DataFrame:
    """One row about a run: entities, versions, base rate, the model chosen on val, temperature, and each model's val and test figures as a map."""
    figures = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.concat_ws("/", "model", "split"), F.struct("log_loss", "accuracy", "ece")))))
    rows = evaluations.where("split IN ('val', 'test')").agg(figures.alias("figures")).crossJoin(F.broadcast(choose_model(evaluations)))  # one row
    return rows.select(F.lit(n_entities).alias("n_entities"), F.array(*map(F.lit, versions)).cast("array<string>").alias("versions"), F.lit(base_rate).alias("base_rate"), F.col("model").alias("best_model"), F.lit(temperature).alias("temperature"), "figures")


def model_lift(team: list[int], rates: DataFrame, weights: DataFrame, n: int = 200, seed: int = 1) -> DataFrame:
    """For each candidate: P(team and candidate) less the mean P(candidate and four others) over n draws by hash.

    A draw's mates are entities at hashed places of the vocabulary, so draws need no state; a draw that
    holds the candidate, or an entity twice, is left out.
    """
    spark = rates.sparkSession
    vocab = weights.select("entity_id", "weight", (F.row_number().over(Window.orderBy("entity_id")) - 1).alias("place"))
    size = vocab.count()
    draws = spark.range(n).select(F.col("id").alias("draw"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("mate")).select("draw", "mate", F.pmod(F.xxhash64("draw", "mate", F.lit(seed)), F.lit(size)).alias("place"))
    teams = draws.join(F.broadcast(vocab), "place").groupBy("draw").agg(F.sum("weight").alias("w"), F.collect_set("entity_id").alias("mates")).where(F.size("mates") == 4)
    own = vocab.where(~F.col("entity_id").isin(team)).select(F.col("entity_id").alias("candidate"), F.col("weight").alias("cw"))
    base = vocab.where(F.col("entity_id").isin(team)).agg(F.sum("weight").alias("tw"))
    random = own.join(F.broadcast(teams), ~F.array_contains("mates", F.col("candidate"))).groupBy("candidate", "cw").agg(F.avg(est.sigmoid(F.col("cw") + F.col("w"))).alias("alone"), F.count("*").alias("draws"))
    return random.crossJoin(F.broadcast(base)).select("candidate", "draws", (est.sigmoid(F.col("tw") + F.col("cw")) - F.col("alone")).alias("lift"))


def unseen_pairs(test: DataFrame, train: DataFrame) -> DataFrame:
    """For each test match, how many of its twenty pairs of team mates never met in train, and low, mid or high."""
    both = lambda df: df.select("game_id", F.explode(F.concat(rt.unordered_pairs(F.col("blue")), rt.unordered_pairs(F.col("red")))).alias("p")).select("game_id", "p.a", "p.b")
    seen = both(train).select("a", "b").distinct().withColumn("seen", F.lit(1))
    rows = both(test).join(seen, ["a", "b"], "left").groupBy("game_id").agg(F.count_if(F.col("seen").isNull()).alias("unseen"))
    return rows.withColumn("level", F.when(F.col("unseen") == 0, "low").when(F.col("unseen") <= 3, "mid").otherwise("high"))


def shuffled_labels(df: DataFrame, seed: int = 0) -> DataFrame:
    """The labels in another row's place: both sides numbered, one of them in the order of a hash."""
    rows = numbered(df, ["created_ms", "game_id"]).drop("blue_wins")
    labels = numbered(df.select(F.xxhash64("game_id", F.lit(seed)).alias("_h"), "game_id", "blue_wins"), ["_h", "game_id"]).select("place", "blue_wins")
    return rows.join(labels, "place").drop("place")


def leak_checks(df: DataFrame, seed: int = 0, least_correlation: float = 0.9, most_accuracy: float = 0.65, loss_slack: float = 0.005, accuracy_slack: float = 0.02) -> DataFrame:
    """(check, value, bound, alarm): four signs that labels leak into a model, or that it can't learn, for matches split by time (split is train or val).

    shuffled_loss and shuffled_accuracy: a model of shuffled training labels mustn't beat a constant on val, in log-loss by ``loss_slack`` or in accuracy by
    ``accuracy_slack`` over the more frequent side. planted_correlation: with labels drawn from known weights of the entities, the fitted ones must correlate with
    these. accuracy: with the true labels, more than ``most_accuracy`` on val is too good. Further feature columns (``leak_...``, numbers) join the
    entities' features, so a column that knows the label shows up.
    """
    train = df.where("split = 'train'")
    ids = [r["entity_id"] for r in build_vocab(train).collect()]  # one row for each entity
    more = [c for c in df.columns if c.startswith("leak_")]
    width = len(ids) + len(more)
    extra = F.array(*[F.struct(F.lit(len(ids) + i).alias("place"), F.col(c).cast("double").alias("value")) for i, c in enumerate(more)])
    extra = F.filter(extra, lambda x: F.coalesce(x["value"], F.lit(0.0)) != 0) if more else F.array().cast("array<struct<place:int,value:double>>")
    uniform = lambda *of: (F.pmod(F.xxhash64(*of, F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    normal = lambda e: F.sqrt(-2 * F.ln(uniform(e, F.lit("a")))) * F.cos(2 * math.pi * uniform(e, F.lit("b"))) / 2
    total = lambda side: F.aggregate(side, F.lit(0.0), lambda acc, e: acc + normal(e))
    planted = (uniform("game_id", F.lit("c")) < est.sigmoid(total("blue") - total("red"))).cast("double")
    mixed = shuffled_labels(train.select("created_ms", "game_id", "blue_wins"), seed).select("game_id", F.col("blue_wins").cast("double").alias("shuffled"))
    rows = two_team_places(df.withColumn("true", F.col("blue_wins").cast("double")).withColumn("planted", planted), ids).withColumn("sparse", F.concat("sparse", extra))
    rows = rows.select("game_id", "split", "true", "planted", "sparse").join(mixed, "game_id", "left")
    rows = as_vectors(rows, width)
    train, val = rows.where("split = 'train'"), rows.where("split = 'val'")
    n = train.count()
    fit = lambda label: fit_lr(train, label, 1.0, n)
    shuffled = binary_metrics(predicted(fit("shuffled"), val), "true", "p").first()
    accuracy = binary_metrics(predicted(fit("true"), val), "true", "p").first()["accuracy"]
    base = val.agg(F.avg("true")).first()[0]
    weights = weights_of(fit("planted"), [*ids, *[-1 - i for i in range(len(more))]], df.sparkSession).where("id >= 0")
    correlation = weights.agg(F.corr("weight", normal(F.col("id")))).first()[0]
    out = [
        ("shuffled_loss", shuffled["log_loss"], shuffled["constant_log_loss"] - loss_slack, shuffled["log_loss"] <= shuffled["constant_log_loss"] - loss_slack),
        ("shuffled_accuracy", shuffled["accuracy"], max(base, 1 - base) + accuracy_slack, shuffled["accuracy"] >= max(base, 1 - base) + accuracy_slack),
        ("planted_correlation", correlation, least_correlation, correlation is None or correlation <= least_correlation),
        ("accuracy", accuracy, most_accuracy, accuracy > most_accuracy),
    ]
    return df.sparkSession.createDataFrame([(c, float(v) if v is not None else None, float(b), bool(a)) for c, v, b, a in out], "check string, value double, bound double, alarm boolean")


def compare_windows(windows: dict[str, DataFrame], val: DataFrame, test: DataFrame, vocab: list[int]) -> DataFrame:
    """Metrics on one val and test for a model of each training window."""
    out = None
    for name, train in windows.items():
        model = fit_lr(two_team_features(train.withColumn("label", F.col("blue_wins").cast("double")), vocab))
        for split, df in (("val", val), ("test", test)):
            scored = predicted(model, two_team_features(df.withColumn("label", F.col("blue_wins").cast("double")), vocab))
            rows = binary_metrics(scored, "label", "p").select(F.lit(name).alias("window"), F.lit(split).alias("split"), "*")
            out = rows if out is None else out.unionByName(rows)
    return out


def seed_ensemble(train: DataFrame, df: DataFrame, seeds: tuple[int, ...], vocab: list[int], c: float = 1.0) -> DataFrame:
    """Mean probability of models that are fitted after swaps with different seeds."""
    rows = two_team_features(df, vocab)
    for s in seeds:
        model = fit_lr(two_team_features(swap_augment(train, s).withColumn("label", F.col("blue_wins").cast("double")), vocab), c=c)
        rows = predicted(model, rows).withColumnRenamed("p", f"p{s}")
    return rows.withColumn("p", sum((F.col(f"p{s}") for s in seeds), F.lit(0.0)) / len(seeds)).drop(*[f"p{s}" for s in seeds])


def weights_of(model, vocab: list[int], spark: SparkSession) -> DataFrame:
    """Weights of a fitted model as a table."""
    return spark.createDataFrame([(i, int(v), float(w)) for i, (v, w) in enumerate(zip(vocab, model.coefficients.toArray(), strict=True))], "index int, id long, weight double")
