"""Several results in one run: a graph of steps that knows which of them are read more than once.

A Dataset's operators only build plans, so a result that two others need, or that one operator reads twice, would be
computed twice. Here steps are declared first; run() counts how often each is read by the steps that lead to the wanted results,
computes those that are read more than once a single time, into a table in the shared folder (so lost executors cost no
recomputation either), and leaves all others to Spark as plans. Sources are plain scans, which Spark prunes for each reader, so they stay
plans as well.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..dataset import Dataset
from ..functions import shared
from ..sources import files

#: How often the operators of the library read an input.
READS = {"map": 3, "join": 1, "nearest": 2, "cover": 2, "difference": 2}


@dataclass(frozen=True, eq=False)
class Step:
    """make builds the result from the inputs' results; reads is how often it reads each of them."""

    make: Callable
    inputs: tuple[Step, ...] = ()
    reads: int = 1

    def then(self, make: Callable, *others: Step, reads: int = 1) -> Step:
        return Step(make, (self, *others), reads)


def _in_order(wanted: Iterable[Step]) -> list[Step]:
    """Every step that leads to a wanted one, after its inputs."""
    out: dict[Step, None] = {}

    def visit(step: Step) -> None:
        if step not in out:
            for i in step.inputs:
                visit(i)
            out[step] = None

    for step in wanted:
        visit(step)
    return list(out)


def stored(result: Dataset | DataFrame) -> Dataset | DataFrame:
    """The result as a table in the shared folder."""
    if isinstance(result, Dataset):
        return Dataset(stored(result.regions), stored(result.meta))
    return shared.stored(result)


def run(wanted: list[Step]) -> list:
    """The results of the wanted steps."""
    steps = _in_order(wanted)
    uses = dict.fromkeys(steps, 0)
    for step in steps:
        for i in step.inputs:
            uses[i] += step.reads
    for step in wanted:
        uses[step] += 1
    done: dict[Step, object] = {}
    for step in steps:
        result = step.make(*(done[i] for i in step.inputs))
        done[step] = stored(result) if step.inputs and uses[step] > 1 else result
    return [done[step] for step in wanted]


def write(wanted: dict[str, Step], kind: str = "parquet") -> None:
    """Writes the results of several steps, each to its folder; what they share is computed once."""
    for folder, result in zip(wanted, run(list(wanted.values())), strict=True):
        files.write(result, folder, kind)
