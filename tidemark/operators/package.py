"""Model packages: trees, preprocessing and selection metrics as JSON under a manifest of digests; verified before they score."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .checks import ContractError
from .model import Preprocessor, contributions, feature_set

# Fixed value: what the labels of every package claim to be.
BOUNDARY = "public_announcement_of_insolvency_process"
FILES = ("model.json", "preprocessor.json", "metrics.json")


def exported(model) -> list[dict]:
    """The trees of a fitted booster as plain nodes {f, t, l, r} or {v, n}; a leaf's value is what it adds to the log odds."""

    def node(x, weight: float) -> dict:
        if x.getClass().getSimpleName() == "LeafNode":
            return {"v": 2.0 * weight * x.prediction(), "n": float(x.impurityStats().count())}
        split = x.split()
        if split.getClass().getSimpleName() != "ContinuousSplit":
            raise ContractError("only splits by a threshold can be exported")
        return {"f": split.featureIndex(), "t": split.threshold(), "l": node(x.leftChild(), weight), "r": node(x.rightChild(), weight)}

    java = model._java_obj
    return [node(t.rootNode(), w) for t, w in zip(java.trees(), java.treeWeights(), strict=True)]


def _value(tree: dict, x: np.ndarray) -> np.ndarray:
    if "v" in tree:
        return np.full(len(x), tree["v"])
    return np.where(x[:, tree["f"]] <= tree["t"], _value(tree["l"], x), _value(tree["r"], x))


@dataclass(frozen=True)
class Package:
    feature_set: str
    trees: list[dict]
    preprocessor: Preprocessor
    metrics: dict

    def score(self, rows: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
        """keep and score of every row; the trees travel with the task and work on whole batches."""
        plain = self.preprocessor.transform(rows, keep)
        names, trees = self.preprocessor.names(), self.trees
        packed = plain.select(*[F.col(f"`{c}`") for c in keep], F.array(*[F.col(f"`{n}`") for n in names]).alias("x_"))

        def run(batches: Iterator) -> Iterator:
            for b in batches:
                x = np.array(b["x_"].tolist(), np.float64).reshape(len(b), len(names))
                margin = sum((_value(t, x) for t in trees), np.zeros(len(x)))
                yield b.drop(columns="x_").assign(score=1 / (1 + np.exp(-margin)))

        return packed.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in packed.schema.fields if f.name != "x_") + ", score double")

    def explain(self, x: np.ndarray) -> dict[str, float]:
        """Contributions of a row of prepared features to its log odds, folded back to raw features, with model_bias; their sum is the log odds."""
        names = self.preprocessor.names()
        parts, bias = contributions(self.trees, x, len(names))
        out = {"model_bias": bias}
        for name, v in zip(names, parts, strict=True):
            raw = name.split("=", 1)[0]
            out[raw] = out.get(raw, 0.0) + v
        return out


def log_odds(score: float) -> float:
    return math.log(score / (1 - score))


def save(folder: str, name: str, model, pre: Preprocessor, metrics: dict) -> Package:
    """A new folder with the package's files and their manifest; an existing one is an error."""
    numeric, categorical = feature_set(name)
    kept = {**metrics, "feature_set": name, "label_boundary": BOUNDARY, "numeric": list(numeric), "categorical": list(categorical)}
    trees = exported(model)
    text = {"model.json": {"width": len(pre.names()), "trees": trees}, "preprocessor.json": {"feature_set": name, "label_boundary": BOUNDARY, "plan": json.loads(pre.to_json())}, "metrics.json": kept}
    to = Path(folder)
    to.mkdir(parents=True, exist_ok=False)
    for f, value in text.items():
        (to / f).write_text(json.dumps(value, indent=2), encoding="utf-8")  # unsorted: the order of features is that of the trees
    manifest = {f: {"bytes": (to / f).stat().st_size, "sha256": hashlib.sha256((to / f).read_bytes()).hexdigest()} for f in FILES}
    (to / "manifest.json").write_text(json.dumps(manifest, sort_keys=True, indent=2), encoding="utf-8")
    return Package(name, trees, pre, kept)


def load(folder: str) -> Package:
    """The package of a folder, after all its checks: files, sizes, digests, one claim and one feature set throughout, and the width of the trees."""
    at = Path(folder)
    if missing := [f for f in (*FILES, "manifest.json") if not (at / f).is_file()]:
        raise ContractError(f"missing: {', '.join(missing)}")
    try:
        manifest = {k: (v["bytes"], v["sha256"]) for k, v in json.loads((at / "manifest.json").read_text(encoding="utf-8")).items()}
    except (ValueError, KeyError, TypeError, AttributeError) as e:
        raise ContractError("the manifest can't be read") from e
    if missing := sorted(set(FILES) - set(manifest)):
        raise ContractError(f"the manifest lacks: {', '.join(missing)}")
    for f, (size, digest) in manifest.items():
        data = (at / f).read_bytes() if (at / f).is_file() else None
        if data is None:
            raise ContractError(f"missing: {f}")
        if len(data) != size:
            raise ContractError(f"size differs: {f}")
        if hashlib.sha256(data).hexdigest() != digest:
            raise ContractError(f"digest differs: {f}")
    model, plan, metrics = (json.loads((at / f).read_text(encoding="utf-8")) for f in FILES)
    if metrics.get("label_boundary") != BOUNDARY or plan.get("label_boundary") != BOUNDARY:
        raise ContractError("the labels claim something else")
    if metrics.get("feature_set") != plan.get("feature_set"):
        raise ContractError("selection and preprocessing name different feature sets")
    numeric, categorical = feature_set(metrics["feature_set"])
    pre = Preprocessor(**plan["plan"])
    if metrics.get("numeric") != list(numeric) or sorted(pre.medians) != sorted(numeric):
        raise ContractError("numeric features differ from the feature set")
    if metrics.get("categorical") != list(categorical) or sorted(pre.categories) != sorted(categorical):
        raise ContractError("categorical features differ from the feature set")
    if model.get("width") != len(pre.names()):
        raise ContractError("the trees are of another width than the prepared features")
    return Package(metrics["feature_set"], model["trees"], pre, metrics)


def same_model(package: Package, evaluated: dict, index: dict) -> None:
    """What a service needs before it starts: its model, the evaluation that set its bands and its index stand for one feature set and one snapshot."""
    if evaluated.get("feature_set") != package.feature_set:
        raise ContractError("the evaluation is of another feature set")
    if evaluated.get("snapshot") != index.get("snapshot"):
        raise ContractError("evaluation and index are of different snapshots")
