"""Searches over masks: candidates are lazy tables, scored by weighted metrics, logged row by row."""

from __future__ import annotations

import copy
import inspect
import json
import math
import random
from collections.abc import Callable, Sequence
from itertools import islice, permutations

from pyspark.sql import DataFrame, SparkSession

from veilwork.core import at_once, checkpointed
from veilwork.plans.cache import content
from veilwork.errors import (
    InputError,
    LessThanOrEqualToZeroError,
    LessThanZeroError,
    NoMutationAvailableError,
    NotInRangeError,
    SumNotEqualToOneError,
)

#: Accepted masks after which lineage is cut.
DEPTH = 5


def even_split(n: int) -> list[float]:
    """Equal parts in whole percents, the rest on the first ones."""
    return [(100 // n + (1 if i < 100 % n else 0)) / 100 for i in range(n)]


def _shares(items: Sequence[dict], name: str, digits: int | None) -> list[float]:
    given = [i[name] for i in items if name in i]
    if given and len(given) != len(items):
        raise ValueError(f"{name} is given for all or for none")
    if not given:
        return even_split(len(items)) if items else []
    total = round(sum(given), digits) if digits is not None else sum(given)
    if total != 1:
        raise SumNotEqualToOneError(f"the values of {name} sum to {total}")
    return list(map(float, given))


class Logbook:
    """Rows of a search: fitness, mask, metric values with weights, headers; a DataFrame at the end."""

    def __init__(self, headers: Sequence[str] = ()):
        self.headers, self.rows = list(headers), []

    def add(self, fitness: float, mutation: object, metrics: Sequence[tuple[str, float, float]], error: str | None = None, **values: object) -> None:
        self.rows.append({"fitness": fitness, "mut_log": str(mutation), **{n: (v, w) for n, v, w in metrics}, **{h: values.get(h) for h in self.headers}, "error_log": error})

    def frame(self, spark: SparkSession) -> DataFrame:
        names = list(dict.fromkeys(n for r in self.rows for n, v in r.items() if isinstance(v, tuple)))
        rows = [(i, float(r["fitness"]), r["mut_log"], *[r.get(n) for n in names], *[None if r[h] is None else float(r[h]) for h in self.headers], r["error_log"]) for i, r in enumerate(self.rows)]
        kind = "step int, fitness double, mut_log string" + "".join(f", `{n}` struct<value: double, weight: double>" for n in names) + "".join(f", {h} double" for h in self.headers) + ", error_log string"
        return spark.createDataFrame(rows, kind)


class Search:
    """Common parts. ``mutations``: ``{name or function: arguments, "p": chance}``; ``metrics``: the same with ``"weight"``.

    A mask gets the current table first; a metric gets ``df``, ``orig_df`` or ``mod_df`` by the names of its arguments
    (else the current table) and returns a number. Names are looked up in ``functions``.
    """

    headers: tuple[str, ...] = ()

    def __init__(
        self, target: DataFrame, mutations: Sequence[dict], metrics: Sequence[dict], iters: int = 10, reuse_mutations: bool = True,
        randomize_mutations: bool = True, theta: float = 0.0, exit_on_error: bool = True, callback: Callable[[int, float], None] | None = None,
        functions: dict[str, Callable] | None = None, seed: int = 1234,
    ):
        if iters < 0:
            raise LessThanZeroError("iters is below zero")
        if not 0 <= theta <= 1:
            raise NotInRangeError("theta lies between 0 and 1")
        self.p, self.weights = _shares(mutations, "p", 5), _shares(metrics, "weight", None)
        self.target, self.mutations, self.metrics = target, list(mutations), list(metrics)
        self.reuse = reuse_mutations and randomize_mutations
        self.randomize, self.theta, self.exit_on_error, self.callback = randomize_mutations, theta, exit_on_error, callback
        self.iters = iters if self.reuse else min(iters, len(self.mutations))
        self.functions, self.random = functions or {}, random.Random(seed)
        self.log = Logbook(self.headers)

    def _call(self, item: dict, skip: str) -> tuple[str, Callable, dict]:
        (f, args), *more = [(k, v) for k, v in item.items() if k != skip]
        if more:
            raise ValueError("one function per entry")
        found = f if callable(f) else self.functions.get(f)
        if found is None:
            raise ValueError(f"unknown function {f}")
        return getattr(found, "__name__", str(f)), found, dict(args or {})

    def evaluate(self, df: DataFrame) -> tuple[float, list[tuple[str, float, float]], str | None]:
        """Weighted mean of the metrics, and each one's value; infinite where one fails and errors are tolerated."""
        found = []
        try:
            for item, w in zip(self.metrics, self.weights, strict=True):
                name, f, args = self._call(item, "weight")
                wanted = inspect.signature(f).parameters
                given = {k: v for k, v in (("df", df), ("mod_df", df), ("orig_df", self.target)) if k in wanted}
                value = f(**given, **args) if given else f(df, **args)
                if not isinstance(value, (int, float)):
                    raise TypeError(f"{name} gave no number")
                found.append((name, float(value), w))
        except Exception as e:
            if self.exit_on_error:
                raise
            return math.inf, found, f"{type(e).__name__}: {e}"
        return sum(v * w for _, v, w in found) / (sum(self.weights) or 1), found, None

    def mutate(self, df: DataFrame, item: dict) -> tuple[DataFrame, dict, str | None]:
        name, f, args = self._call(item, "p")
        try:
            out = f(df, **copy.copy(args))
            if not isinstance(out, DataFrame):
                raise ValueError(f"{name} gave no table")
            return out, {name: args}, None
        except Exception as e:
            if self.exit_on_error:
                raise
            return df, {name: args}, f"{type(e).__name__}: {e}"

    def choose(self) -> dict:
        if not self.left:
            raise NoMutationAvailableError("no mask is left")
        at = self.random.choices(range(len(self.left)), self.left_p)[0] if self.randomize else 0
        item = self.left[at]
        if not self.reuse:
            del self.left[at], self.left_p[at]
            total = sum(self.left_p)
            self.left_p = [p / total for p in self.left_p] if total else self.left_p
        return item

    def _begin(self, **values: object) -> float:
        self.left, self.left_p, self.accepted = list(self.mutations), list(self.p), 0
        self.log = Logbook(self.headers)
        fitness, found, error = self.evaluate(self.target)
        self.log.add(fitness, {}, found, error, **values)
        return fitness

    def _cut(self, df: DataFrame) -> DataFrame:
        self.accepted += 1
        return checkpointed(df) if self.accepted % DEPTH == 0 else df

    def _tell(self, i: int, fitness: float) -> None:
        if self.callback is not None:
            self.callback(i, fitness)


class IterativeSearch(Search):
    """Every mask is kept; the result is the last table, or the best one."""

    def __init__(self, *args: object, return_best: bool = False, **options: object):
        super().__init__(*args, **options)
        self.return_best = return_best

    def optimize(self) -> DataFrame:
        current, fitness = self.target, self._begin()
        best, best_fitness = current, fitness
        for i in range(self.iters):
            if fitness <= self.theta:
                break
            current, mutation, error = self.mutate(current, self.choose())
            current = self._cut(current)
            fitness, found, failed = self.evaluate(current)
            if fitness <= best_fitness:
                best, best_fitness = current, fitness
            self.log.add(fitness, mutation, found, error or failed)
            self._tell(i, fitness)
        return best if self.return_best else current


class IncrementalSearch(Search):
    """A mask is kept if it makes the score strictly better; after ``retry`` failures in all the search ends."""

    headers = ("retry",)

    def __init__(self, *args: object, retry: int = 3, **options: object):
        super().__init__(*args, **options)
        if retry <= 0:
            raise LessThanOrEqualToZeroError("retry must be positive")
        self.retry = retry

    def optimize(self) -> DataFrame:
        left = self.retry
        current, fitness = self.target, self._begin(retry=left)
        for i in range(self.iters):
            if fitness <= self.theta or not left:
                break
            candidate, mutation, error = self.mutate(current, self.choose())
            new, found, failed = self.evaluate(candidate)
            if new < fitness:
                current, fitness = self._cut(candidate), new
            else:
                left -= 1
            self.log.add(fitness, mutation, found, error or failed, retry=left)
            self._tell(i, fitness)
        return current


class StochasticSearch(Search):
    """A changed table is kept if better, or by chance ``exp((current - new) / T)``; T falls by ``alpha`` a step."""

    headers = ("temperature", "cur_fitness", "best_fitness")

    def __init__(self, *args: object, alpha: float = 0.05, temperature: float = 1.0, **options: object):
        super().__init__(*args, **options)
        if not 0 <= alpha <= 1 or not 0 <= temperature <= 1:
            raise NotInRangeError("alpha and temperature lie between 0 and 1")
        self.alpha, self.temperature = alpha, temperature

    def optimize(self) -> DataFrame:
        t = self.temperature
        fitness = self._begin(temperature=t)
        current = best = self.target
        best_fitness, hold = fitness, content(self.target)
        for i in range(self.iters):
            if best_fitness <= self.theta:
                break
            candidate, mutation, error = self.mutate(current, self.choose())
            new, found, failed = self.evaluate(candidate)
            held = content(candidate)
            chance = 1.0 if new < fitness else math.exp((fitness - new) / t) if t > 0 and math.isfinite(new) else 0.0
            if held != hold and chance > self.random.random():
                current, fitness, hold = self._cut(candidate), new, held
                if fitness < best_fitness:
                    best, best_fitness = current, fitness
            t *= 1 - self.alpha
            self.log.add(new, mutation, found, error or failed, temperature=t, cur_fitness=fitness, best_fitness=best_fitness)
            self._tell(i, fitness)
        return best


class ExhaustiveSearch(Search):
    """Every order of ``size_perms`` masks, scored after each step; tables and scores of common beginnings are kept.

    ``branches`` orders are taken at a time, and their new beginnings of one length are made and scored side by side, each
    from a thread of the driver and in a scheduler pool of its own (which a fair scheduler heeds). The log is that of one
    order after the other; where ``theta`` ends the search, up to ``branches`` orders were tried in vain. An error counts
    when its order comes.
    """

    headers = ("perm_num",)

    def __init__(self, *args: object, num_perms: int | None = None, size_perms: int | None = None, return_best: bool = True, branches: int = 4, **options: object):
        options.setdefault("iters", 1 << 30)
        super().__init__(*args, **options | {"reuse_mutations": True})
        if num_perms is not None and num_perms <= 0 or size_perms is not None and size_perms <= 0:
            raise LessThanOrEqualToZeroError("num_perms and size_perms must be positive")
        if branches <= 0:
            raise LessThanOrEqualToZeroError("branches must be positive")
        self.branches = branches
        self.num_perms, self.size_perms, self.return_best = num_perms, size_perms or len(self.mutations), return_best

    def optimize(self) -> DataFrame:
        fitness = self._begin(perm_num=0)
        best, best_fitness, last, steps, number = self.target, fitness, self.target, 0, 0
        known: dict[tuple[int, ...], tuple | Exception] = {}
        orders = islice(permutations(range(len(self.mutations)), self.size_perms), self.num_perms)
        while wave := list(islice(orders, min(self.branches, max(1, -(-(self.iters - steps) // self.size_perms))))):
            if steps < self.iters and best_fitness > self.theta:
                self._grow(known, wave)
            for order in wave:
                number += 1
                for k in range(len(order)):
                    if steps >= self.iters or best_fitness <= self.theta:
                        return best if self.return_best else last
                    step = known[order[: k + 1]]
                    if isinstance(step, Exception):
                        raise step
                    current, mutation, error, fitness, found, failed = step
                    last, steps = current, steps + 1
                    if fitness < best_fitness:
                        best, best_fitness = current, fitness
                    self.log.add(fitness, mutation, found, error or failed, perm_num=number)
                    self._tell(steps, fitness)
        return best if self.return_best else last

    def _grow(self, known: dict[tuple[int, ...], tuple | Exception], orders: list[tuple[int, ...]]) -> None:
        """Adds all beginnings of ``orders`` that aren't known, the shorter first."""
        context = self.target.sparkSession.sparkContext

        def branch(head: tuple[int, ...]) -> tuple | Exception:
            before = known[head[:-1]] if len(head) > 1 else (self.target,)
            if isinstance(before, Exception):
                return before
            context.setLocalProperty("spark.scheduler.pool", f"branch-{'-'.join(map(str, head))}")
            try:
                made, mutation, error = self.mutate(before[0], self.mutations[head[-1]])
                made = checkpointed(made) if self.size_perms - len(head) > 1 else made  # two orders or more go on from it
                return (made, mutation, error, *self.evaluate(made))
            except Exception as e:  # raised when its order comes
                return e
            finally:
                context.setLocalProperty("spark.scheduler.pool", None)

        for k in range(1, self.size_perms + 1):
            new = [h for h in dict.fromkeys(order[:k] for order in orders) if h not in known]
            known |= zip(new, at_once(branch, new, self.branches), strict=True)


KINDS = {"iterative": IterativeSearch, "incremental": IncrementalSearch, "stochastic": StochasticSearch, "exhaustive": ExhaustiveSearch}


def from_config(target: DataFrame, config: dict | str, *more: dict | str, functions: dict[str, Callable] | None = None) -> list[Search]:
    """Searches of a configuration: a dict, or a path to JSON that Spark can read; later ones replace sections of earlier ones.

    ``mitigations`` and ``metrics`` are lists as of a search, by names in ``functions``; ``optimizations`` maps kinds
    (iterative, incremental, stochastic, exhaustive) to their options.
    """
    sections: dict = {}
    for part in (config, *more):
        sections |= part if isinstance(part, dict) else json.loads("\n".join(r.value for r in target.sparkSession.read.text(part, wholetext=True).collect()))
    if missing := {"mitigations", "metrics", "optimizations"} - set(sections):
        raise InputError(f"the configuration lacks {', '.join(sorted(missing))}")
    if odd := set(sections["optimizations"]) - set(KINDS):
        raise InputError(f"unknown searches: {', '.join(sorted(odd))}")
    return [KINDS[k](target, sections["mitigations"], sections["metrics"], functions=functions, **(options or {})) for k, options in sections["optimizations"].items()]


def apply_and_evaluate(
    target: DataFrame, mutations: Sequence[dict], metrics: Sequence[dict], functions: dict[str, Callable] | None = None,
) -> tuple[DataFrame, float, DataFrame]:
    """All masks in their order as one lazy chain, scored once: the table, its score and the log."""
    run = Search(target, [{k: v for k, v in m.items() if k != "p"} for m in mutations], metrics, functions=functions)
    current, done = target, []
    for item in run.mutations:
        current, mutation, _ = run.mutate(current, item)
        done.append(mutation)
    fitness, found, _ = run.evaluate(current)
    run.log.add(fitness, done, found)
    return current, fitness, run.log.frame(target.sparkSession)
