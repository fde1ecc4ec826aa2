"""User functions: loaded from files, made into scorers, registered for SQL, stopped after a time."""

from __future__ import annotations

import importlib.util
import multiprocessing
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource
from pyspark.sql.types import DoubleType

from quillon.plans.staging import stage


def load_function(path: str, name: str, **bound) -> Callable:
    """The function of that name in a Python file, with keyword arguments bound."""
    spec = importlib.util.spec_from_file_location("loaded_extension", path)
    if spec is None or spec.loader is None:
        raise FileNotFoundError(path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    if not hasattr(module, name):
        raise AttributeError(f"no {name} in {path}")
    f = getattr(module, name)
    return (lambda *a, **k: f(*a, **(bound | k))) if bound else f


def row_scorer(f: Callable[[str, str, str], float]) -> Callable[[Column, Column, Column], Column]:
    """A score column from a function (data source, response, truth) -> number, an Arrow batch at a time.

    A row whose call fails scores 0.
    """

    @F.pandas_udf(DoubleType())
    def udf(source: pd.Series, response: pd.Series, truth: pd.Series) -> pd.Series:
        def one(*x) -> float:
            try:
                return float(f(*x))
            except Exception:  # noqa: BLE001
                return 0.0

        return pd.Series([one(*x) for x in zip(source, response, truth)], dtype=float)

    return udf


def batch_scorer(f: Callable[[list, list, list], list[float]]) -> Callable[[Column, Column, Column], Column]:
    """A score column from a function of lists."""

    @F.pandas_udf(DoubleType())
    def udf(source: pd.Series, response: pd.Series, truth: pd.Series) -> pd.Series:
        return pd.Series(f(source.tolist(), response.tolist(), truth.tolist()), dtype=float)

    return udf


def library_verifier(timeout_score: float = 0.0) -> Callable[[Column, Column, Column], Column]:
    """Scores by the external verifier of mathematical answers, where it is installed; else ImportError."""
    from math_verify.errors import TimeoutException
    from math_verify.metric import math_metric
    from math_verify.parser import ExprExtractionConfig, LatexExtractionConfig

    def score(source: str, response: str, truth: str) -> float:
        verify = math_metric(gold_extraction_target=(LatexExtractionConfig(),), pred_extraction_target=(ExprExtractionConfig(), LatexExtractionConfig()))
        try:
            return verify(["\\boxed{" + truth + "}"], [response])[0]
        except TimeoutException:
            return timeout_score

    return row_scorer(score)


def register(spark: SparkSession, name: str, f: Callable, kind: str = "double") -> None:
    """Make a function callable from SQL."""
    spark.udf.register(name, f, kind)


def _call(send, f, args) -> None:
    try:
        send.send((True, f(*args)))
    except Exception as e:  # noqa: BLE001
        send.send((False, repr(e)))


def with_timeout(f: Callable, seconds: float) -> Callable:
    """f in a process of its own that is killed after `seconds`; then TimeoutError."""

    def run(*args):
        ctx = multiprocessing.get_context("fork")
        receive, send = ctx.Pipe(duplex=False)
        p = ctx.Process(target=_call, args=(send, f, args))
        p.start()
        try:
            if not receive.poll(seconds):
                raise TimeoutError(f"over {seconds} s")
            ok, value = receive.recv()
        finally:
            p.kill()
            p.join()
        if not ok:
            raise RuntimeError(value)
        return value

    return run


def load_source(spark: SparkSession, path: str, name: str) -> type:
    """The data source class of that name in a Python file, registered under its own name for spark.read.format()."""
    cls = load_function(path, name)
    if not (isinstance(cls, type) and issubclass(cls, DataSource)):
        raise TypeError(f"{name} is no data source")
    spark.dataSource.register(cls)
    return cls


class Dispatch:
    """Ways of spreading a table over workers and of putting the results together, by name.

    A way is (spread, collect): spread(df, workers) gives a table with the column worker, collect(df) the result.
    """

    def __init__(self):
        self._ways: dict[str, tuple[Callable, Callable]] = {}
        keep = lambda df: df.drop("worker")
        self.register("one_to_all", lambda df, n: df.withColumn("worker", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))), lambda df: df)
        self.register("all_to_all", lambda df, n: df, lambda df: df)
        self.register("rank_zero", lambda df, n: df.withColumn("worker", F.lit(0)), keep)
        self.register("contiguous", self._contiguous, keep)
        self.register("by_hash", lambda df, n: df.withColumn("worker", F.pmod(F.xxhash64(*df.columns), F.lit(n)).cast("int")), keep)

    @staticmethod
    def _contiguous(df: DataFrame, n: int) -> DataFrame:
        from quillon.operators.sampling import with_position

        rows = df.count()
        return with_position(df, [df.columns[0]], "_at").withColumn("worker", F.expr(f"cast(_at div {max(1, -(-rows // n))} as int)")).drop("_at")

    def register(self, name: str, spread: Callable, collect: Callable) -> None:
        """A new way; a name that is taken is an error (see update)."""
        if name in self._ways:
            raise KeyError(f"{name} is taken")
        self._ways[name] = spread, collect

    def update(self, name: str, spread: Callable, collect: Callable) -> None:
        if name not in self._ways:
            raise KeyError(f"no way {name}")
        self._ways[name] = spread, collect

    def run(self, name: str, df: DataFrame, f: Callable[[pd.DataFrame], pd.DataFrame], schema: str, workers: int) -> DataFrame:
        """f over each worker's rows; schema is f's own. Rows of a worker go through f in batches."""
        spread, collect = self._ways[name]
        given = spread(df, workers)
        if "worker" in given.columns:
            given = given.repartition(workers, "worker")
        return collect(given.mapInPandas(lambda batches: (f(b) for b in batches), schema))


class Tool:
    """What a tool does in a conversation: a state for each request, a reply and a reward for each call."""

    def create(self, request: str, **options) -> object:
        """The state that a request begins with."""
        return None

    def execute(self, state: object, arguments: str) -> tuple[object, str, float]:
        """(new state, reply, reward of the call)."""
        raise NotImplementedError

    def calc_reward(self, state: object) -> float:
        """The reward of the request as a whole."""
        return 0.0

    def release(self, state: object) -> None:
        """The request is over."""


class AnswerTool(Tool):
    """A tool to which answers are handed in: the best score counts, and a call that doesn't improve costs a little."""

    def __init__(self, score: Callable[[str], float], penalty: float = -0.05):
        self.score, self.penalty = score, penalty

    def create(self, request: str, **options) -> float:
        return 0.0

    def execute(self, state: float, arguments: str) -> tuple[float, str, float]:
        x = float(self.score(arguments))
        return max(state, x), f"Current parsed {arguments=} reward={x}", 0.0 if x > state else self.penalty

    def calc_reward(self, state: float) -> float:
        return state


def call_tools(calls: DataFrame, tools: dict[str, Tool]) -> DataFrame:
    """(request, turn, tool, reply, reward, total) of calls (request, turn, tool, arguments), in the order of the turns.

    total is the reward of the tool's part of the request so far. A request's calls depend on each other and go through
    one worker; requests are spread. A failing call replies with its error and earns nothing; unknown tools do so too.
    """

    def run(g: pd.DataFrame) -> pd.DataFrame:
        states: dict[str, object] = {}
        out = []
        for r in g.sort_values("turn").itertuples():
            try:
                tool = tools[r.tool]
                if r.tool not in states:
                    states[r.tool] = tool.create(r.request)
                states[r.tool], reply, reward = tool.execute(states[r.tool], r.arguments)
                total = tool.calc_reward(states[r.tool])
            except Exception as e:  # noqa: BLE001
                reply, reward, total = f"error: {e!r}", 0.0, 0.0
            out.append((r.request, r.turn, r.tool, reply, float(reward), float(total)))
        for name, state in states.items():
            tools[name].release(state)
        return pd.DataFrame(out, columns=["request", "turn", "tool", "reply", "reward", "total"])

    return calls.groupBy("request").applyInPandas(run, "request string, turn long, tool string, reply string, reward double, total double")


def chat_rounds(requests: DataFrame, respond: Callable[[DataFrame], DataFrame], follow_up: Callable[[DataFrame], DataFrame], most: int = 16) -> DataFrame:
    """All responses, with round: respond(requests) answers a round, and follow_up(responses) gives the requests of the
    next, of the same columns, until there are none; after `most` rounds it is an error."""
    done = None
    for k in range(most):
        answers = stage(respond(requests).withColumn("round", F.lit(k)), "chat-round")
        done = answers if done is None else done.unionByName(answers)
        requests = stage(follow_up(answers.drop("round")), "chat-requests")
        if requests.isEmpty():
            return done
    raise RuntimeError(f"requests are left after {most} rounds")
