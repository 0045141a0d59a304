"""Tabular preparation: fit is an aggregate, the fitted stage is a SQL projection.

Estimators return SQLTransformer / ML stages holding literal constants, so a
fitted PipelineModel runs inside the JVM and is saved and loaded by Spark itself.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, PCA, SQLTransformer, StringIndexerModel, VectorAssembler
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..core import bounded_values, broadcast_if_small, clean_nan, col, columns_of, materialize, new_path, numeric_columns, quoted, type_class
from .frequency import most_frequent, top_per_group, value_counts, value_text
from .quantiles import exact_quantiles

#: What a kept list ends with where a slot stands for all other values seen in training.
INFREQUENT = None
#: Inside the model values carry a mark that the slot has not, so no text can equal it.
SLOT, MARK = "infrequent", "="
MAX_DUMMY_COLUMNS = 10_000


# --- SQL text ----------------------------------------------------------------


def number_sql(value: float) -> str:
    return f"{float(value)!r}D"


def text_sql(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def double_sql(name: str) -> str:
    """Column as a double with NaN read as missing."""
    return f"nanvl(cast({quoted(name)} AS double), cast(NULL AS double))"


def category_sql(df: DataFrame, name: str) -> str:
    text = f"cast({quoted(name)} AS string)"
    return f"initcap({text})" if isinstance(df.schema[name].dataType, T.BooleanType) else text


def replacing(exprs: dict[str, str]) -> SQLTransformer:
    """Stage that replaces columns; all others pass through."""
    if not exprs:
        return SQLTransformer(statement="SELECT * FROM __THIS__")
    gone = ", ".join(quoted(c) for c in exprs)
    made = ", ".join(f"{e} AS {quoted(c)}" for c, e in exprs.items())
    return SQLTransformer(statement=f"SELECT * EXCEPT ({gone}), {made} FROM __THIS__")


# --- impute ------------------------------------------------------------------


class ImputeNumbers(Estimator):
    """mean, median, most_frequent (smallest on ties) or constant; all-null columns stay NULL."""

    def __init__(self, cols: Sequence[str], strategy: str = "median", fill: float = 0.0):
        super().__init__()
        if strategy not in ("mean", "median", "most_frequent", "constant"):
            raise ValueError(f"unknown strategy: {strategy}")
        self.cols, self.strategy, self.fill = list(cols), strategy, fill

    def constants(self, df: DataFrame) -> dict[str, float | None]:
        df = clean_nan(df)
        if not self.cols:
            return {}
        if self.strategy == "mean":
            row = df.agg(*[F.avg(col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(self.cols)]).first()
            return {c: row[i] for i, c in enumerate(self.cols)}
        if self.strategy == "median":
            return {c: q[0] for c, q in exact_quantiles(df, self.cols, [0.5]).items()}
        if self.strategy == "most_frequent":
            found = {r["column"]: float(r["value"]) for r in most_frequent(df, self.cols).collect()}
            return {c: found.get(c) for c in self.cols}
        return {c: self.fill for c in self.cols}

    def _fit(self, df: DataFrame) -> SQLTransformer:
        return replacing({
            c: double_sql(c) if v is None else f"coalesce({double_sql(c)}, {number_sql(v)})"
            for c, v in self.constants(df).items()
        })


class ImputeCategories(Estimator):
    """most_frequent (smallest on ties) or a constant text."""

    def __init__(self, cols: Sequence[str], strategy: str = "most_frequent", fill: str = "__MISSING__"):
        super().__init__()
        if strategy not in ("most_frequent", "constant"):
            raise ValueError(f"unknown strategy: {strategy}")
        self.cols, self.strategy, self.fill = list(cols), strategy, fill

    def _fit(self, df: DataFrame) -> SQLTransformer:
        if not self.cols:
            return replacing({})
        if self.strategy == "constant":
            fills = {c: self.fill for c in self.cols}
        else:
            fills = {r["column"]: r["value"] for r in most_frequent(df.select(
                *[value_text(df, c).alias(c) for c in self.cols]), self.cols).collect()}
        return replacing({
            c: f"coalesce({category_sql(df, c)}, {text_sql(fills.get(c, self.fill))})" for c in self.cols
        })


# --- scale -------------------------------------------------------------------


class Scale(Estimator):
    """standard (population deviation), minmax or robust (median, quartile range).

    A zero spread divides by 1.
    """

    def __init__(self, cols: Sequence[str], method: str = "standard"):
        super().__init__()
        if method not in ("standard", "minmax", "robust"):
            raise ValueError(f"unknown scaling: {method}")
        self.cols, self.method = list(cols), method

    def constants(self, df: DataFrame) -> dict[str, tuple[float, float]]:
        df = clean_nan(df)
        if not self.cols:
            return {}
        if self.method == "robust":
            found = {c: (q[1], None if q[0] is None else q[2] - q[0])
                     for c, q in exact_quantiles(df, self.cols, [0.25, 0.5, 0.75]).items()}
        else:
            aggs = []
            for i, c in enumerate(self.cols):
                v = col(c).cast("double")
                a, b = (F.avg(v), F.stddev_pop(v)) if self.method == "standard" else (F.min(v), F.max(v) - F.min(v))
                aggs += [a.alias(f"a{i}"), b.alias(f"b{i}")]
            row = df.agg(*aggs).first()
            found = {c: (row[f"a{i}"], row[f"b{i}"]) for i, c in enumerate(self.cols)}
        return {c: (a or 0.0, b or 1.0) for c, (a, b) in found.items()}

    def _fit(self, df: DataFrame) -> SQLTransformer:
        return replacing({
            c: f"({double_sql(c)} - {number_sql(a)}) / {number_sql(b)}" for c, (a, b) in self.constants(df).items()
        })


# --- categories --------------------------------------------------------------


def label_codes(df: DataFrame, column: str, null_text: str = "nan") -> DataFrame:
    """(value, code): sorted distinct values numbered from 0; missing is coded as its text."""
    values = df.select(F.coalesce(value_text(df, column), F.lit(null_text)).alias("value")).distinct()
    # sorted once into a table; each value knows its partition and place therein,
    # and one short row per partition tells where the partition starts
    placed = materialize(values.orderBy("value").withColumn("id", F.monotonically_increasing_id()), "codes")
    part, place = F.shiftright("id", 33), F.col("id").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return placed.withColumn("part", part).join(broadcast_if_small(starts), "part").select(
        "value", (F.col("start") + place).alias("code")
    )


def label_encode(df: DataFrame, cols: Sequence[str], null_text: str = "nan") -> DataFrame:
    """Replace text columns by their codes in sorted order."""
    names = df.columns
    for c in cols:
        codes = label_codes(df, c, null_text).withColumnRenamed("code", "_code")
        df = (
            df.withColumn("value_", F.coalesce(value_text(df, c), F.lit(null_text)))
            .join(broadcast_if_small(codes.withColumnRenamed("value", "value_")), "value_")
            .withColumn(c, F.col("_code"))
            .drop("value_", "_code")
        )
    return df.select(*[col(n) for n in names])


class LabelEncode(Estimator):
    """Saveable form of label_encode; fitted labels are part of the model."""

    def __init__(self, cols: Sequence[str], null_text: str = "nan"):
        super().__init__()
        self.cols, self.null_text = list(cols), null_text

    def _fit(self, df: DataFrame) -> PipelineModel:
        fill = replacing({c: f"coalesce({category_sql(df, c)}, {text_sql(self.null_text)})" for c in self.cols})
        filled = fill.transform(df)
        stages = [fill]
        for c in self.cols:
            values = filled.select(col(c)).distinct().orderBy(quoted(c))
            labels = [r[0] for r in bounded_values(values, f"values in {c}; use label_encode")]
            stages.append(SQLTransformer(statement=f"SELECT *, {quoted(c)} AS _text FROM __THIS__"))
            stages.append(StringIndexerModel.from_labels(labels, inputCol="_text", outputCol="_code", handleInvalid="error"))
            stages.append(SQLTransformer(statement=f"SELECT * EXCEPT ({quoted(c)}, _text, _code), cast(_code AS bigint) AS {quoted(c)} FROM __THIS__"))
        return PipelineModel(stages)


def one_hot(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Boolean columns `col_value` in sorted order; missing gives all false; other columns come first."""
    kept = [col(c) for c in df.columns if c not in cols]
    made = []
    for c in cols:
        text = value_text(df, c)
        distinct = df.select(text.alias("v")).where(F.col("v").isNotNull()).distinct().orderBy("v")
        values = [r[0] for r in bounded_values(distinct, f"values in {c}; use the vector encoder", MAX_DUMMY_COLUMNS)]
        made += [text.eqNullSafe(F.lit(v)).alias(f"{c}_{v}") for v in values]
    return df.select(*kept, *made)


class OneHotVector(Estimator):
    """One vector per category column (`<col>_vec`); unseen values give the zero vector.

    max_categories keeps the most frequent max_categories - 1 values and one slot
    for all others seen in training; those stand in a table below the work folder, which
    save_pipeline puts beside the model. drop: None, "first" or "if_binary".
    """

    def __init__(self, cols: Sequence[str], *, max_categories: int | None = None, drop: str | None = None,
                 handle_unknown: str = "ignore"):
        super().__init__()
        if drop not in (None, "first", "if_binary") or handle_unknown not in ("ignore", "error"):
            raise ValueError("unknown one-hot option")
        self.cols, self.max_categories = list(cols), max_categories
        self.drop, self.handle_unknown = drop, handle_unknown

    def categories(self, df: DataFrame) -> dict[str, list[str | None]]:
        """Kept categories per column, sorted; the slot for infrequent values comes last.

        With max_categories any number of values will do; without, all have to fit MAX_VOCABULARY.
        """
        counted = value_counts(df, self.cols).where(F.col("value").isNotNull())
        limit = self.max_categories
        if limit is None:
            rows = bounded_values(counted, "categories")
        else:
            rows = top_per_group(counted, ["column"], [F.col("n").desc(), F.col("value")], limit + 1).collect()
        found: dict[str, list[tuple[int, str]]] = {c: [] for c in self.cols}
        for r in rows:
            found[r["column"]].append((-r["n"], r["value"]))
        out = {}
        for c, values in found.items():
            if limit is not None and len(values) > limit:
                out[c] = sorted(v for _, v in sorted(values)[: limit - 1]) + [INFREQUENT]
            else:
                out[c] = sorted(v for _, v in values)
        return out

    def fold_infrequent(self, df: DataFrame, kept: dict[str, list[str | None]]) -> SQLTransformer:
        """Stage that adds `_cat<i>`, the marked value or the slot; it joins the other values seen in training, a
        written table, to tell infrequent from unknown ones."""
        capped = [c for c in self.cols if kept[c] and kept[c][-1] is INFREQUENT]
        texts = {c: category_sql(df, c) for c in self.cols}
        marked = {c: f"concat({text_sql(MARK)}, {e})" for c, e in texts.items()}
        joins, gone = "", [quoted(c) for c in self.cols]
        if capped:
            path = new_path(df.sparkSession, "seen")
            keep = df.sparkSession.createDataFrame([(c, v) for c in capped for v in kept[c][:-1]], "column string, value string")
            place = F.array_position(F.array(*[F.lit(c) for c in capped]), F.col("column")) - 1
            seen = value_counts(df, capped).where(F.col("value").isNotNull()).join(F.broadcast(keep), ["column", "value"], "left_anti")
            seen.select(place.cast("int").alias("place"), "value").write.partitionBy("place").parquet(path)
            for k, c in enumerate(capped):
                joins += f" LEFT JOIN (SELECT value AS _seen{k} FROM parquet.`{path}/place={k}`) ON _seen{k} = {texts[c]}"
                marked[c] = f"CASE WHEN _seen{k} IS NOT NULL THEN {text_sql(SLOT)} ELSE {marked[c]} END"
                gone.append(f"_seen{k}")
        made = [f"{e} AS {quoted(c)}" for c, e in texts.items()] + [f"{e} AS _cat{i}" for i, e in enumerate(marked.values())]
        return SQLTransformer(statement=f"SELECT * EXCEPT ({', '.join(gone)}), {', '.join(made)} FROM __THIS__{joins}")

    def _fit(self, df: DataFrame) -> PipelineModel:
        if not self.cols:
            return Pipeline(stages=[replacing({})]).fit(df)
        kept = self.categories(df)
        stages: list = [self.fold_infrequent(df, kept)]
        for i, c in enumerate(self.cols):
            labels = [SLOT if v is INFREQUENT else MARK + v for v in kept[c]]
            drops = self.drop == "first" or (self.drop == "if_binary" and len(labels) == 2)
            if self.handle_unknown == "ignore":
                # the slot of unseen values is the one dropped; a dropped category is left unseen too
                labels, last = (labels[1:] if drops else labels), True
            else:
                labels, last = (labels[1:] + labels[:1] if drops else labels), drops
            keep = "keep" if self.handle_unknown == "ignore" else "error"
            stages.append(StringIndexerModel.from_labels(labels or [SLOT], inputCol=f"_cat{i}", outputCol=f"_idx{i}", handleInvalid=keep))
            stages.append(OneHotEncoder(inputCol=f"_idx{i}", outputCol=f"_vec{i}", dropLast=last, handleInvalid="error"))
        gone = ", ".join(f"_cat{i}, _idx{i}, _vec{i}" for i in range(len(self.cols)))
        named = ", ".join(f"_vec{i} AS {quoted(c + '_vec')}" for i, c in enumerate(self.cols))
        stages.append(SQLTransformer(statement=f"SELECT * EXCEPT ({gone}), {named} FROM __THIS__"))
        return Pipeline(stages=stages).fit(df)


# --- numeric features --------------------------------------------------------


def polynomial_names(cols: Sequence[str]) -> list[tuple[str, str]]:
    """(name, SQL) of degree-2 terms without bias: x, y, x^2, x y, y^2."""
    out = [(c, double_sql(c)) for c in cols]
    for i, a in enumerate(cols):
        for b in cols[i:]:
            out.append((f"{a}^2" if a == b else f"{a} {b}", f"{double_sql(a)} * {double_sql(b)}"))
    return out


def polynomial_stage(cols: Sequence[str]) -> SQLTransformer:
    """Terms first, then the columns that are not expanded."""
    terms = ", ".join(f"{e} AS {quoted(n)}" for n, e in polynomial_names(cols))
    return SQLTransformer(statement=f"SELECT {terms}, * EXCEPT ({', '.join(quoted(c) for c in cols)}) FROM __THIS__")


class PrincipalComponents(Estimator):
    """First min(k, columns) components PCA1.. of centered columns, in their place.

    The largest loading of each component is positive.
    """

    def __init__(self, cols: Sequence[str], k: int = 5):
        super().__init__()
        self.cols, self.k = list(cols), min(k, len(cols))

    def loadings(self, df: DataFrame) -> tuple[list[float], list[list[float]]]:
        vectors = VectorAssembler(inputCols=[f"c{i}" for i in range(len(self.cols))], outputCol="v", handleInvalid="skip").transform(
            clean_nan(df).select(*[col(c).cast("double").alias(f"c{i}") for i, c in enumerate(self.cols)])
        )
        model = PCA(k=self.k, inputCol="v", outputCol="p").fit(vectors)
        row = vectors.agg(*[F.avg(f"c{i}").alias(f"m{i}") for i in range(len(self.cols))]).first()
        matrix = model.pc.toArray()
        out = []
        for j in range(self.k):
            v = matrix[:, j]
            sign = -1.0 if v[abs(v).argmax()] < 0 else 1.0
            out.append([float(x * sign) for x in v])
        return [row[i] for i in range(len(self.cols))], out

    def _fit(self, df: DataFrame) -> SQLTransformer:
        means, comps = self.loadings(df)
        made = ", ".join(
            " + ".join(f"({double_sql(c)} - {number_sql(m)}) * {number_sql(w)}" for c, m, w in zip(self.cols, means, comp))
            + f" AS PCA{j + 1}" for j, comp in enumerate(comps)
        )
        return SQLTransformer(statement=f"SELECT {made}, * EXCEPT ({', '.join(quoted(c) for c in self.cols)}) FROM __THIS__")


# --- whole preparation -------------------------------------------------------


# The defaults.
@dataclass(frozen=True)
class PrepConfig:
    numeric_cols: tuple[str, ...] | None = None
    categorical_cols: tuple[str, ...] | None = None
    num_impute: str = "median"
    cat_impute: str = "most_frequent"
    scaler: str = "standard"
    one_hot_drop: str | None = None
    handle_unknown: str = "ignore"
    max_ohe_categories: int | None = 200
    treat_bool_as_categorical: bool = True
    target: str | None = None


# Named presets.
PRESETS = {
    "baseline": PrepConfig(),
    "robust": PrepConfig(scaler="robust"),
    "minimal": PrepConfig(scaler="none", max_ohe_categories=300),
}


def make_config(preset: str = "baseline", **overrides) -> PrepConfig:
    """A preset with changed fields; an unknown preset is the baseline."""
    return replace(PRESETS.get(preset, PRESETS["baseline"]), **overrides)


def column_role(field: T.StructField, cfg: PrepConfig) -> str:
    """What the preparation does with a field: 'number' or 'category', by its type alone."""
    kind = type_class(field.dataType)
    return "number" if kind in ("int", "float") or kind == "bool" and not cfg.treat_bool_as_categorical else "category"


def detect_roles(df: DataFrame, cfg: PrepConfig) -> tuple[list[str], list[str]]:
    """(numeric, categorical) columns without the target, each in schema order."""
    roles = [(column_role(f, cfg), f.name) for f in df.schema.fields if f.name != cfg.target]
    return [n for role, n in roles if role == "number"], [n for role, n in roles if role == "category"]


def build_preprocessor(df: DataFrame, cfg: PrepConfig | None = None, out: str = "features") -> tuple[Pipeline, list[str], list[str]]:
    """(pipeline to fit, numeric columns, categorical columns) producing one feature vector."""
    cfg = cfg or make_config()
    numeric, other = detect_roles(df, cfg)
    numeric = list(cfg.numeric_cols) if cfg.numeric_cols is not None else numeric
    other = list(cfg.categorical_cols) if cfg.categorical_cols is not None else other
    stages: list = []
    if numeric:
        stages.append(ImputeNumbers(numeric, cfg.num_impute))
        if cfg.scaler != "none":
            stages.append(Scale(numeric, cfg.scaler))
    if other:
        stages.append(ImputeCategories(other, cfg.cat_impute))
        stages.append(OneHotVector(other, max_categories=cfg.max_ohe_categories, drop=cfg.one_hot_drop,
                                   handle_unknown=cfg.handle_unknown))
    inputs = numeric + [f"{c}_vec" for c in other]
    # the assembler reads dots and spaces in names as paths: such columns pass by a name of their own
    odd = {c: f"_in{i}" for i, c in enumerate(inputs) if not re.fullmatch(r"\w+", c)}
    if odd:
        stages.append(SQLTransformer(statement=f"SELECT *, {', '.join(f'{quoted(c)} AS {n}' for c, n in odd.items())} FROM __THIS__"))
    stages.append(VectorAssembler(inputCols=[odd.get(c, c) for c in inputs], outputCol=out, handleInvalid="keep"))
    gone = [quoted(f"{c}_vec") for c in other] + list(odd.values())
    if gone:
        stages.append(SQLTransformer(statement=f"SELECT * EXCEPT ({', '.join(gone)}) FROM __THIS__"))
    return Pipeline(stages=stages), numeric, other


def prepare(
    df: DataFrame, *, missing: str = "none", encoding: str = "none", scaling: str = "none", target: str | None = None
) -> DataFrame:
    """Impute numbers, encode text, scale numbers (label codes included, dummies and target not)."""
    number = [c for c in numeric_columns(df) if c != target]
    text = [c for c in columns_of(df, "object") if c != target]
    order = df.columns
    if missing != "none" and number:
        strategy = {"mode": "most_frequent"}.get(missing, missing)
        df = ImputeNumbers(number, strategy).fit(df).transform(df).select(*[quoted(c) for c in order])
    if encoding == "label":
        df = label_encode(df, text)
        number = number + text
    elif encoding == "one_hot":
        df = one_hot(df, text)
    elif encoding != "none":
        raise ValueError(f"unknown encoding: {encoding}")
    if scaling != "none" and number:
        order = df.columns
        df = Scale(number, scaling).fit(df).transform(df).select(*[quoted(c) for c in order])
    return df


_SEEN = re.compile(r"FROM parquet\.`([^`]+)/place=\d+`")


def save_pipeline(model: PipelineModel, path: str) -> None:
    """Save a model and, in its folder, the tables of seen values that it joins; the saved model is read where it was saved."""
    spark = SparkSession.active()
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    whole = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()
    tables: dict[str, str] = {}

    def pointed(stage):
        if isinstance(stage, PipelineModel):
            return PipelineModel([pointed(s) for s in stage.stages])
        if isinstance(stage, SQLTransformer) and (m := _SEEN.search(stage.getStatement())):
            to = tables.setdefault(m[1], new_path(spark, "seen").rpartition("/")[2])
            return SQLTransformer(statement=stage.getStatement().replace(f"`{m[1]}/", f"`{whole}/{to}/"))
        return stage

    own = pointed(model)
    # a table in the folder to be overwritten is read before
    read = {source: materialize(spark.read.parquet(source), "seen") for source in tables}
    saved = own if tables else model
    saved.write().overwrite().save(path)
    for source, to in tables.items():
        read[source].write.partitionBy("place").parquet(f"{whole}/{to}")


def load_pipeline(path: str) -> PipelineModel:
    return PipelineModel.load(path)
