"""Feature building: polynomial terms, components, TF-IDF, split."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame

from ..core import col, columns_of, numeric_columns
from ..operators.prep import PrincipalComponents, polynomial_names, polynomial_stage
from ..operators.split import parts, random_split
from ..operators.textprep import fit_tfidf_columns


@dataclass(frozen=True)
class FeatureSplit:
    train: DataFrame
    test: DataFrame
    model: PipelineModel


def build_features(
    df: DataFrame,
    target: str,
    keys: Sequence[str],
    *,
    polynomial: bool = False,
    pca: bool = False,
    tfidf: bool = False,
    test_share: float = 0.2,
    fit_on: str = "train",
    components: int = 5,
    max_features: int = 500,
) -> FeatureSplit:
    """Split, then fit the chosen steps on the training rows (or on all rows).

    Key and target columns pass through unchanged.
    """
    if fit_on not in ("train", "all"):
        raise ValueError("fit_on is 'train' or 'all'")
    if not 0.1 <= test_share <= 0.5:
        raise ValueError("test_share must lie between 0.1 and 0.5")
    split = random_split(df, keys, test_share)
    train, test = parts(split)
    base = df if fit_on == "all" else train
    fixed = {target, *keys}
    numbers = [c for c in numeric_columns(df) if c not in fixed]
    texts = [c for c in columns_of(df, "object") if c not in fixed]
    stages: list = []
    if polynomial and numbers:
        stages.append(polynomial_stage(numbers))
        numbers = [n for n, _ in polynomial_names(numbers)]
        base = stages[-1].transform(base)
    if pca and numbers:
        stages.append(PrincipalComponents(numbers, components).fit(base))
        base = stages[-1].transform(base)
    if tfidf and texts:
        model, _ = fit_tfidf_columns(base.select(*[col(c) for c in texts]), texts, max_features)
        stages += model.stages
    model = PipelineModel(stages)
    return FeatureSplit(model.transform(train), model.transform(test), model)
