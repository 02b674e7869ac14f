"""Named transforms of records, losses and objectives, and what runs before and after a plan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import divergence
from ..operators import metrics
from ..sources import records
from ..sources.registry import Registry
from . import mixing

OFFLINE, ONLINE, LOSSES, OBJECTIVES = (Registry(k) for k in ("offline transform", "online transform", "loss", "objective"))


@dataclass(frozen=True)
class Policy:
    """What a transform of drawn rows says of itself. Costs may be planned from its result if it has a name for its version, gives the same
    rows whenever it runs, and keeps which images there are, their geometry and their places in the text."""

    fingerprint: str
    deterministic: bool = True
    keeps_images: bool = True
    keeps_geometry: bool = True
    keeps_placeholders: bool = True

    def __post_init__(self):
        if not self.fingerprint.strip():
            raise ValueError("a policy needs a fingerprint")

    @property
    def planning_safe(self) -> bool:
        return self.deterministic and self.keeps_images and self.keeps_geometry and self.keeps_placeholders


@dataclass(frozen=True)
class Transform:
    """A function of a DataFrame, and its policy if it has one."""

    apply: Callable[..., DataFrame]
    policy: Policy | None = None

    @property
    def planning_safe(self) -> bool:
        return self.policy is not None and self.policy.planning_safe


def offline(name: str):
    """Register a transform of whole tables, which runs before rows are drawn."""
    return lambda fn: OFFLINE.register(name)(Transform(fn, Policy(name))).apply


def online(name: str, policy: Policy | None = None):
    """Register a transform of drawn rows; without a policy it is not safe for planning."""
    return lambda fn: ONLINE.register(name)(Transform(fn, policy)).apply


def safe_steps(steps: list[dict], kind: Registry = ONLINE) -> list[Transform]:
    """The transforms of some steps; raises for one that costs cannot be planned from."""
    found = [kind.get(step["name"]) for step in steps]
    for step, transform in zip(steps, found):
        if not transform.planning_safe:
            raise ValueError(f"{step['name']} is not safe for planning")
    return found


def planning_fingerprint(steps: list[dict], kind: Registry = ONLINE) -> str:
    """What a plan made from the result of some transforms depends on: their versions and parameters, in order."""
    return mixing.fingerprint(steps=[[t.policy.fingerprint, step] for step, t in zip(steps, safe_steps(steps, kind))])


def applied(rows: DataFrame, steps: list[dict], kind: Registry = OFFLINE, planning: bool = False) -> DataFrame:
    """The rows after some transforms, each {"name": .., parameters}; raises for one that is not safe where costs are planned from the result."""
    if planning:
        safe_steps(steps, kind)
    for step in steps:
        rows = kind.get(step["name"]).apply(rows, **{k: v for k, v in step.items() if k != "name"})
    return rows


@offline("dedup_image_target")
def dedup_image_target(rows: DataFrame, order: str = "row_index") -> DataFrame:
    """Of rows with equal images and target the first; rows without a target are all kept."""
    return records.keep_first(rows, ["image_paths", "target_text"], [order], optional="target_text")


@offline("drop_empty_target")
def drop_empty_target(rows: DataFrame) -> DataFrame:
    return rows.filter(F.coalesce(records.strip(F.col("target_text")), F.lit("")) != "")


@online("prompt_variant", Policy("prompt_variant-1"))
def prompt_variant(rows: DataFrame, prompts: list[str], seed: str = "0", draw: str = "draw_id") -> DataFrame:
    """user_prompt drawn from some prompts by a hash of seed and draw: the same whenever it runs."""
    from .sampling import hash_choice

    return rows.withColumn("user_prompt", hash_choice(prompts, F.lit(seed), F.col(draw).cast("string")))


@online("shuffle_options", Policy("shuffle_options-1", deterministic=False))
def shuffle_options(rows: DataFrame, column: str) -> DataFrame:
    """The elements of an array in an order of chance."""
    return rows.withColumn(column, F.shuffle(column))


LOSSES.register("token_mean")(metrics.token_mean)
for _kind in ("reverse_kl", "forward_kl", "jsd"):
    OBJECTIVES.register(_kind)(lambda student, teacher, kind=_kind: divergence.divergence(student, teacher, kind))


def objective(name: str, student: Column, teacher: Column, temperature: float = 1.0) -> Column:
    """A divergence of two arrays of logits at a temperature, times its square."""
    made = OBJECTIVES.create(name, divergence.log_softmax(student, temperature), divergence.log_softmax(teacher, temperature))
    return made * float(temperature * temperature)


class Hooks:
    """Functions by event, called in the order they were added; what an interceptor returns goes on to the next."""

    def __init__(self):
        self.by_event: dict[str, list[Callable]] = {}

    def on(self, event: str, fn: Callable) -> None:
        self.by_event.setdefault(event, []).append(fn)

    def intercept(self, event: str, rows: DataFrame) -> DataFrame:
        for fn in self.by_event.get(event, []):
            rows = fn(rows) or rows
        return rows
