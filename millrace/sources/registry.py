"""Named readers of datasets, and the selection of which to open."""

from __future__ import annotations

import json

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Reader = Callable[[SparkSession, list[str]], DataFrame]


class Registry:
    """Names to functions; a name can be taken once."""

    def __init__(self, kind: str):
        self.kind, self.entries = kind, {}

    def register(self, name: str):
        def add(fn):
            if name in self.entries:
                raise ValueError(f"{self.kind} {name!r} is registered already")
            self.entries[name] = fn
            return fn

        return add

    def get(self, name: str):
        if name not in self.entries:
            raise KeyError(f"unknown {self.kind} {name!r}; there are {', '.join(sorted(self.entries))}")
        return self.entries[name]

    def has(self, name: str) -> bool:
        return name in self.entries

    def create(self, name: str, *args, **params):
        """What the function of a name makes of some parameters."""
        return self.get(name)(*args, **params)

    def names(self) -> list[str]:
        return sorted(self.entries)


READERS = Registry("reader")


@dataclass(frozen=True)
class Source:
    """A dataset of a catalogue: where it lies, how it is read, and its part in a mix."""

    name: str
    reader: str
    train: list[str] = field(default_factory=list)
    val: list[str] = field(default_factory=list)
    weight: float = 1.0
    enabled: bool = True
    use_for_eval: bool = True


def catalogue(payload: dict | list, catalog_names: list[str] | None = None, base: str | None = None) -> list[Source]:
    """Sources of a mapping by name, or of a list with names; a name may stand once.

    ``catalog_names`` picks some, in their order. Relative paths are taken from the folder ``base``.
    """
    rows = [{"name": k, **v} for k, v in payload.items()] if isinstance(payload, dict) else list(payload)
    names = [r.get("name") for r in rows]
    if len(set(names)) < len(names) or None in names:
        raise ValueError("each source needs a name of its own")
    if catalog_names is not None:
        if unknown := [n for n in catalog_names if n not in names]:
            raise ValueError(f"not in the catalogue: {', '.join(unknown)}")
        rows = [rows[names.index(n)] for n in catalog_names]
    return [Source(**{k: [resolve(p, base) for p in v] if k in ("train", "val") else v for k, v in r.items()}) for r in rows]


def resolve(path: str, base: str | None) -> str:
    return path if base is None or path.startswith("/") or ":/" in path else f"{base.rstrip('/')}/{path}"


def parse_yaml(text: str) -> dict | list:
    """A catalogue in YAML; needs PyYAML, JSON is read without it."""
    try:
        return json.loads(text)
    except ValueError:
        pass
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("PyYAML is needed to read a YAML catalogue; JSON can be read without it") from e
    return yaml.safe_load(text)


def read_catalogue(spark: SparkSession, path: str, catalog_names: list[str] | None = None, inline: list[Source] = ()) -> list[Source]:
    """The sources of a catalogue file, which is small, and those given inline; relative paths are taken from the file's folder."""
    text = spark.read.text(path, wholetext=True).first()[0]
    found = [*catalogue(parse_yaml(text), catalog_names, path.rpartition("/")[0] or "."), *inline]
    if len({s.name for s in found}) < len(found):
        raise ValueError("a name stands in the catalogue and inline")
    return found


def open_split(spark: SparkSession, sources: list[Source], split: str) -> DataFrame | None:
    """The union of the sources a split uses, with dataset_name and dataset_no, their order; others are not opened.

    Training takes enabled sources of positive weight, validation enabled ones marked for evaluation.
    """
    wanted = [s for s in sources if s.enabled and (s.weight > 0 if split == "train" else s.use_for_eval) and getattr(s, split)]
    frames = [READERS.get(s.reader)(spark, list(getattr(s, split))).withColumns({"dataset_name": F.lit(s.name), "dataset_no": F.lit(k)}) for k, s in enumerate(wanted)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames) if frames else None


def check_splits(train: DataFrame, val: DataFrame, known: DataFrame, id_col: str) -> None:
    """Raises if ids repeat within a split, stand in both, or are not known."""
    for name, ids in (("train", train), ("val", val)):
        if not ids.groupBy(id_col).count().filter("count > 1").isEmpty():
            raise ValueError(f"{name} repeats ids")
        if not ids.join(known, id_col, "left_anti").isEmpty():
            raise ValueError(f"{name} names ids that are not there")
    if not train.join(val, id_col, "left_semi").isEmpty():
        raise ValueError("train and val overlap")


def check_unique(rows: DataFrame, id_col: str) -> DataFrame:
    """The rows; raises if an id repeats."""
    if not rows.groupBy(id_col).count().filter("count > 1").isEmpty():
        raise ValueError(f"{id_col} repeats")
    return rows
