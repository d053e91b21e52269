"""Feature tables: selection, labels, statistics, interactions, models."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from moltables.operators.fits import correlation_p_value, f_p_value
from moltables.operators.ordered import ordered

META = ("replicate", "ligand", "mutant")
# Names of feature columns, in any case.
FEATURE_NAMES = (
    r"^res[_\-]?\d+$",
    r"^resi[_\-]?\d+$",
    r"^R\d+$",
    r"^atom[_\-]?\d+$",
)
_NUMERIC = ("double", "float", "int", "bigint", "smallint", "tinyint")


def feature_columns(df: DataFrame, meta: Sequence[str] = META) -> list[str]:
    """Numeric columns named like residues or atoms; failing that, all numeric non-meta columns."""
    numeric = [c for c, t in df.dtypes if c not in meta and (t in _NUMERIC or t.startswith("decimal"))]
    named = [c for c in numeric if any(re.match(p, c, re.IGNORECASE) for p in FEATURE_NAMES)]
    if not (named or numeric):
        raise ValueError("no numeric feature columns")
    return named or numeric


def parse_rule(rule: str) -> tuple[str, str, str, list[str] | None]:
    """GROUP|LIGAND|MUTANT or GROUP|LIGAND|MUTANT|rep,…; ``*`` means every replicate."""
    parts = [p.strip() for p in rule.split("|")]
    if len(parts) not in (3, 4):
        raise ValueError(f"not GROUP|LIGAND|MUTANT|replicates: {rule}")
    reps = None
    if len(parts) == 4 and parts[3] not in ("", "*"):
        reps = [r.strip() for r in parts[3].split(",") if r.strip()]
    return parts[0], parts[1], parts[2], reps


def label_groups(df: DataFrame, rules: Sequence[str], ligand: str = "ligand", mutant: str = "mutant", replicate: str = "replicate",
                 out: str = "group_label", require_rows: bool = True) -> DataFrame:
    """Rows matched by a rule, labelled by the last rule that matches; others are dropped."""
    norm = lambda c: F.lower(F.trim(F.col(c).cast("string")))
    label = None
    for rule in reversed(list(rules)):
        group, lig, mut, reps = parse_rule(rule)
        hit = (norm(ligand) == lig.lower()) & (norm(mutant) == mut.lower())
        if reps is not None:
            hit = hit & norm(replicate).isin([r.lower() for r in reps])
        label = F.when(hit, group) if label is None else label.when(hit, group)
    d = df.withColumn(out, label).filter(F.col(out).isNotNull())
    if require_rows and d.isEmpty():
        seen = {c: [r[0] for r in df.select(F.col(c).cast("string")).distinct().limit(50).collect()] for c in (ligand, mutant, replicate)}
        raise ValueError(f"no row matches the rules; values seen: {seen}")
    return d


def to_long(df: DataFrame, ids: Sequence[str], features: Sequence[str], feature: str = "feature", value: str = "value") -> DataFrame:
    return df.select(*ids, *[F.col(f).cast("double") for f in features]).unpivot(list(ids), list(features), feature, value)


def correlations(long: DataFrame, feature: str, x: str, y: str) -> DataFrame:
    """Per feature: n, Pearson r (0 when undefined), r2, and F = r2/(1-r2)*(n-2)."""
    ok = F.col(x).isNotNull() & F.col(y).isNotNull()
    g = long.filter(ok).groupBy(feature).agg(
        F.count(F.lit(1)).alias("n"), F.try_divide(F.covar_pop(x, y), F.sqrt(F.var_pop(x)) * F.sqrt(F.var_pop(y))).alias("_r"))
    r = F.coalesce(F.nanvl("_r", F.lit(0.0)), F.lit(0.0))
    g = g.withColumn("r", r).withColumn("r2", F.col("r") * F.col("r"))
    f = F.try_divide(F.col("r2") * (F.col("n") - 2), F.lit(1.0) - F.col("r2"))
    return g.select(feature, "n", "r", "r2", f.alias("f_score"))


def with_p_values(stats: DataFrame) -> DataFrame:
    """Add two-sided p of r and the p of F to a correlations table (Arrow batches of feature rows)."""
    @F.pandas_udf("double")
    def p_r(r: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([correlation_p_value(a, int(b)) for a, b in zip(r, n, strict=True)])

    @F.pandas_udf("double")
    def p_f(f: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([f_p_value(a, 1, int(b) - 2) if a == a and b > 2 else None for a, b in zip(f, n, strict=True)])

    return stats.withColumns({"p_value": p_r("r", "n"), "f_p_value": p_f("f_score", "n")})


def anova(long: DataFrame, feature: str, label: str, value: str) -> DataFrame:
    """One-way F per feature across classes, from per-class n, sum and centred squares."""
    d = long.filter(F.col(value).isNotNull())
    g = d.groupBy(feature, label).agg(
        F.count(F.lit(1)).cast("double").alias("_n"), F.avg(value).alias("_m"), F.var_pop(value).alias("_v"))
    a = g.groupBy(feature).agg(
        F.count(F.lit(1)).alias("k"), F.sum("_n").alias("n"), F.sum(F.col("_n") * F.col("_m")).alias("_s"),
        F.sum(F.col("_n") * F.col("_m") * F.col("_m")).alias("_s2"), F.sum(F.col("_n") * F.col("_v")).alias("_within"))
    between = F.col("_s2") - F.col("_s") * F.col("_s") / F.col("n")
    f = F.try_divide(between / (F.col("k") - 1), F.col("_within") / (F.col("n") - F.col("k")))
    return a.select(feature, F.col("k").cast("int").alias("classes"), F.col("n").cast("bigint").alias("n"), f.alias("f_score"))


def top_features(stats: DataFrame, score: str, feature: str, k: int) -> DataFrame:
    return stats.orderBy(F.col(score).desc_nulls_last(), feature).limit(k)


def combined_scores(importance: DataFrame, stats: DataFrame, feature: str) -> DataFrame:
    """Importance times |r|, joined by feature."""
    d = importance.join(stats, feature).withColumn("abs_r", F.abs("r"))
    return d.withColumn("combined", F.col("importance") * F.col("abs_r"))


def encode_residues(sequences: DataFrame, ident: str, residues: str, descriptors: DataFrame) -> DataFrame:
    """(ident, position, feature, value): residues of an array column joined to (aa, feature, value)."""
    d = sequences.select(ident, F.posexplode(residues).alias("position", "aa"))
    return d.join(descriptors, "aa").select(ident, "position", "feature", "value")


def mean_encoding(encoded: DataFrame, ident: str) -> DataFrame:
    return encoded.groupBy(ident, "feature").agg(F.avg("value").alias("value"))


def interactions(encoded: DataFrame, ident: str, pairs: Sequence[tuple[int, int]]) -> DataFrame:
    """Products of every descriptor at one position with every descriptor at another, per sample.

    Labels are ``<i>_<a>*<j>_<b>``. The vectors of a sample hold one entry per
    descriptor, so the product is as wide as the descriptor table squared and
    is expanded row by row, without a join.
    """
    vec = lambda p: F.sort_array(F.collect_list(F.when(F.col("position") == p, F.struct("feature", "value"))))
    used = sorted({p for pair in pairs for p in pair})
    g = encoded.filter(F.col("position").isin(used)).groupBy(ident).agg(*[vec(p).alias(f"_v{p}") for p in used])
    out = None
    for i, j in pairs:
        d = g.select(ident, F.explode(f"_v{i}").alias("_a"), f"_v{j}").select(ident, "_a", F.explode(f"_v{j}").alias("_b"))
        d = d.select(ident, F.concat(F.lit(f"{i}_"), F.col("_a.feature"), F.lit(f"*{j}_"), F.col("_b.feature")).alias("feature"),
                     (F.col("_a.value") * F.col("_b.value")).alias("value"))
        out = d if out is None else out.unionByName(d)
    return out


def bad_lengths(df: DataFrame, text: str, length: int = 4) -> DataFrame:
    """Data-quality row: how many values do not have the wanted length."""
    return df.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.coalesce(F.length(text) == length, F.lit(False))).alias("bad"))


def hash_split(df: DataFrame, ident: str, test_share: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(train, test) by a hash of the id: the same rows on every run and cluster."""
    u = F.pmod(F.xxhash64(F.lit(seed), F.col(ident)), F.lit(1_000_000)) / 1_000_000.0
    return df.filter(u >= test_share), df.filter(u < test_share)


def _assembled(df: DataFrame, features: Sequence[str], keep: Sequence[str]) -> DataFrame:
    from pyspark.ml.functions import array_to_vector
    return df.select(*keep, array_to_vector(F.array(*[F.col(f).cast("double") for f in features])).alias("raw"))


def forest(df: DataFrame, ident: str, features: Sequence[str], response: str, trees: int = 100, seed: int = 42,
           subset: str = "auto", depth: int = 30) -> tuple[float, DataFrame]:
    """(test R2, importances) of a standardised random forest on an 80/20 hash split."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import StandardScaler
    from pyspark.ml.regression import RandomForestRegressor

    d = _assembled(df, features, [ident, F.col(response).cast("double").alias("label")])
    train, test = hash_split(d, ident, seed=seed)
    model = Pipeline(stages=[
        StandardScaler(inputCol="raw", outputCol="features", withMean=True),
        RandomForestRegressor(numTrees=trees, seed=seed, featureSubsetStrategy=subset, maxDepth=depth),
    ]).fit(train)
    e = model.transform(test)
    r2 = e.agg((1.0 - F.sum((F.col("label") - F.col("prediction")) ** 2) / (F.var_pop("label") * F.count(F.lit(1)))).alias("r2")).first()[0]
    imp = model.stages[-1].featureImportances.toArray()
    rows = [(f, float(v)) for f, v in zip(features, imp, strict=True)]
    return r2, df.sparkSession.createDataFrame(rows, "feature string, importance double")


def balanced_folds(df: DataFrame, group: str, folds: int = 3) -> DataFrame:
    """Fold of every row; whole groups (replicates) stay together and folds are near equal.

    Groups are dealt by falling size, back and forth over the folds, so two
    folds differ by no more than the largest group. Rows without a group are
    one group. The sizes are numbered in blocks, and nothing comes to the driver.
    """
    sizes = df.groupBy(F.col(group).alias("_g")).agg(F.count(F.lit(1)).alias("n")).withColumn("_less", -F.col("n"))
    at = ordered(sizes, [], ["_less", "_g"]).row_number("_rn").result()
    turn, place = F.floor((F.col("_rn") - 1) / folds), F.pmod(F.col("_rn") - 1, F.lit(folds))
    fold = F.when(turn % 2 == 0, place).otherwise(folds - 1 - place).cast("int")
    return df.join(at.select("_g", fold.alias("fold")), F.col(group).eqNullSafe(F.col("_g"))).drop("_g")


def grouped_cv(df: DataFrame, features: Sequence[str], label: str, group: str, folds: int = 3, classifier: str = "logistic",
               c: float = 1.0, seed: int = 123, max_iter: int = 4000) -> tuple[list[float], np.ndarray | None]:
    """(accuracy per fold, mean weights) of a standardised classifier, folds by replicate."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
    from pyspark.ml.feature import StandardScaler, StringIndexer

    idx = StringIndexer(inputCol=label, outputCol="label_no", stringOrderType="alphabetAsc").fit(df)
    d = balanced_folds(idx.transform(df), group, folds)
    d = _assembled(d, features, ["fold", F.col("label_no").alias("label")]).cache()
    classes = len(idx.labels)
    accs, weights = [], []
    for k in range(folds):
        train, test = d.filter(F.col("fold") != k), d.filter(F.col("fold") == k)
        n = train.count()
        model = (
            LogisticRegression(family="multinomial", maxIter=max_iter, regParam=1.0 / (c * max(n, 1)), elasticNetParam=0.0, standardization=False)
            if classifier == "logistic" else
            MultilayerPerceptronClassifier(layers=[len(features), 64, classes], maxIter=25, seed=seed))
        fit = Pipeline(stages=[StandardScaler(inputCol="raw", outputCol="features", withMean=True), model]).fit(train)
        acc = fit.transform(test).agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
        accs.append(acc if acc is not None else float("nan"))
        if classifier == "logistic":
            weights.append(fit.stages[-1].coefficientMatrix.toArray())
    d.unpersist()
    return accs, np.mean(weights, axis=0) if weights else None


def weights_table(df: DataFrame, features: Sequence[str], w: np.ndarray) -> DataFrame:
    rows = [(int(k), f, float(w[k, j])) for k in range(w.shape[0]) for j, f in enumerate(features)]
    return df.sparkSession.createDataFrame(rows, "class int, feature string, weight double")


def importance_from_weights(weights: DataFrame) -> DataFrame:
    """(feature, importance): |w|, |w1 - w0|, or the length of class-centred weights, by number of classes."""
    w = F.col("weight")
    g = weights.groupBy("feature").agg(
        F.count(F.lit(1)).alias("k"), F.max(F.when(F.col("class") == 0, w)).alias("_w0"), F.max(F.when(F.col("class") == 1, w)).alias("_w1"),
        F.var_pop(w).alias("_v"))
    imp = F.when(F.col("k") == 1, F.abs("_w0")).when(F.col("k") == 2, F.abs(F.col("_w1") - F.col("_w0"))).otherwise(
        F.sqrt(F.col("_v") * F.col("k")))
    return g.select("feature", imp.alias("importance"))


def greedy_selection(df: DataFrame, candidates: Sequence[str], label: str, group: str, max_k: int = 12, min_gain: float = 1e-3,
                     folds: int = 3) -> list[tuple[int, float, list[str]]]:
    """Forward selection by grouped CV accuracy: the learning curve (k, accuracy, features).

    Candidates come ordered by importance; the first starts the set. Each fit
    is a distributed job; the driver only compares accuracies.
    """
    score = lambda cols: float(np.mean(grouped_cv(df, cols, label, group, folds)[0]))
    chosen = [candidates[0]]
    best = score(chosen)
    curve = [(1, best, list(chosen))]
    rest = list(candidates[1:])
    while len(chosen) < max_k and rest:
        accs = [score([*chosen, f]) for f in rest]
        k = int(np.argmax(accs))
        if accs[k] < best + min_gain:
            break
        chosen.append(rest.pop(k))
        best = accs[k]
        curve.append((len(chosen), best, list(chosen)))
    return curve


def standardised(long: DataFrame, feature: str, value: str, out: str = "z") -> DataFrame:
    """(value - mean) / population sd per feature; constant features become 0."""
    s = long.groupBy(feature).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    z = F.coalesce(F.try_divide(F.col(value) - F.col("_m"), F.col("_s")), F.lit(0.0))
    return long.join(s, feature).withColumn(out, z).drop("_m", "_s")


def projection_scores(long: DataFrame, ident: str, feature: str, value: str, weights: DataFrame) -> DataFrame:
    """Standardised features dotted with the unit weight vector; weights: (feature, weight)."""
    norm = weights.agg(F.sqrt(F.sum(F.col("weight") ** 2)).alias("_n"))
    w = weights.join(F.broadcast(norm)).select(feature, (F.col("weight") / F.col("_n")).alias("_w"))
    z = standardised(long, feature, value)
    return z.join(w, feature).groupBy(ident).agg(F.sum(F.col("z") * F.col("_w")).alias("score"))


def products(rows: DataFrame, label: str, vec: str, shift: np.ndarray) -> DataFrame:
    """(label, i, j, s): sums of products of coordinates i <= j less ``shift``; at i = -2 the sums of coordinate j, at i = -1 the count.

    Each task adds its batches up in one matrix for each class and sends its
    entries once, so what is shuffled does not grow with the rows of a task.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for b in batches:
            if not b.num_rows:
                continue
            x = np.stack(b.column(1).to_numpy(zero_copy_only=False)).astype(float) - shift
            classes = b.column(0).to_pylist()
            for c in dict.fromkeys(classes):
                own = x[[k == c for k in classes]]
                n, total, square = held.get(c, (0, 0.0, 0.0))
                held[c] = n + len(own), total + own.sum(0), square + own.T @ own
        for c, (n, total, square) in held.items():
            i, j = np.triu_indices(len(total))
            cells = [np.concatenate([[-1], np.full(len(total), -2), i]), np.concatenate([[0], np.arange(len(total)), j]), np.concatenate([[float(n)], total, square[i, j]])]
            yield pa.RecordBatch.from_arrays([pa.array([c] * len(cells[0]), kind), *map(pa.array, cells)], [label, "i", "j", "s"])
    own = rows.select(label, vec)
    kind = to_arrow_type(own.schema[label].dataType)
    parts = own.mapInArrow(run, f"`{label}` {own.schema[label].dataType.simpleString()}, i long, j long, s double")
    return parts.groupBy(label, "i", "j").agg(F.sum("s").alias("s"))


def fisher_direction(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """(feature, weight) of the leading discriminant, from class sums of products.

    Tasks add the products up; the driver gets one matrix for each class, as wide as the feature list.
    """
    n = len(features)
    rows = df.select(label, F.array(*[F.col(f).cast("double") for f in features]).alias("_x"))
    got = products(rows, label, "_x", np.zeros(n)).toPandas()
    classes = sorted(got[label].unique())
    total = got.loc[got["i"] == -1, "s"].sum()
    within, means, share = np.zeros((n, n)), [], []
    for c in classes:
        g = got[got[label] == c]
        k = float(g.loc[g["i"] == -1, "s"].iloc[0])
        m = g[g["i"] == -2].sort_values("j")["s"].to_numpy() / k
        upper = g[g["i"] >= 0]
        square = np.zeros((n, n))
        square[upper["i"].to_numpy(int), upper["j"].to_numpy(int)] = upper["s"]
        square = square + np.triu(square, 1).T
        within += (square - k * np.outer(m, m)) / total
        means.append(m)
        share.append(k / total)
    grand = np.array(share) @ np.array(means)
    between = sum(p * np.outer(m - grand, m - grand) for p, m in zip(share, means, strict=True))
    val, vec = np.linalg.eig(np.linalg.pinv(within) @ between)
    w = np.real(vec[:, int(np.argmax(np.real(val)))])
    w = w * np.sign(w[np.abs(w).argmax()])
    return df.sparkSession.createDataFrame([(f, float(v)) for f, v in zip(features, w, strict=True)], "feature string, weight double")


def linker_features(documents: DataFrame, linker_text: Column, descriptors: DataFrame, ident: str = "file") -> DataFrame:
    """(ident, linker, feature, value): mean descriptor of the linker's residues."""
    d = documents.select(ident, linker_text.alias("linker"))
    rows = d.select(ident, "linker", F.explode(F.split("linker", "")).alias("aa")).join(descriptors, "aa")
    return rows.groupBy(ident, "linker", "feature").agg(F.avg("value").alias("value"))


def rename_classes(col: Column, names: Mapping[str, str]) -> Column:
    out = col
    for a, b in names.items():
        out = F.when(col == a, b).otherwise(out)
    return out
