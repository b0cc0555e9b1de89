"""Matching of a stream: targets wait, unclaimed, for sources that arrive with them or later."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallyloom.operators.match import KEY
from tallyloom.operators.normalize import normalize
from tallyloom.operators.turns import Pool, cents_of, days_of, score_of, take_turns
from tallyloom.options import ReconOptions
from tallyloom.plans.strategies import MatchStrategy, default_pipeline

_OUT = "ref string, currency string, s_ordinal bigint, t_ordinal bigint, s_amount decimal(18,2), t_amount decimal(18,2), s_date date, t_date date, strategy string, score decimal(5,4)"
_STATE = "ordinals array<bigint>, amounts array<decimal(18,2)>, dates array<date>"


def normalize_stream(raw: DataFrame, side: str) -> tuple[DataFrame, DataFrame]:
    """normalize holds no state, so it serves streams as it stands."""
    return normalize(raw, side)


def match_stream(transactions: DataFrame, options: ReconOptions | None = None, pipeline: Sequence[MatchStrategy] | None = None, wait: str | None = None) -> DataFrame:
    """Pairs from one stream of both sides (side 'S' or 'T', ref, currency, ordinal, amount, value_date).

    In each micro-batch a bucket's new targets join those that wait, then its new sources take turns in order of ordinal
    with the given built-in strategies. A source that finds nothing isn't kept. State is a bucket's unclaimed
    targets; with wait ('7 days'), a bucket without rows for so much processing time is forgotten (such a stream
    always has a next batch, so the trigger availableNow never ends it). Rows without reference or currency are left out.
    """
    options, pipeline = options or ReconOptions(), default_pipeline() if pipeline is None else list(pipeline)
    wait_ms = int(pd.Timedelta(wait).total_seconds() * 1000) if wait else None

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames))
        waiting = pd.DataFrame(dict(zip(("ordinal", "amount", "value_date"), state.get if state.exists else ([], [], []), strict=True)))
        targets = pd.concat([waiting, rows.loc[rows["side"] == "T", ["ordinal", "amount", "value_date"]]]).rename(columns={"value_date": "date"})
        sources = rows.loc[rows["side"] == "S"].rename(columns={"value_date": "date"})
        if len(sources) and len(targets):
            targets = targets.reset_index(drop=True)
            ordinals = targets["ordinal"].to_numpy("int64")
            pool = Pool(ordinals, ordinals, cents_of(targets["amount"]), days_of(targets["date"]))
            asking = list(zip(range(len(sources)), [None] * len(sources), *[sources["ordinal"].tolist()] * 2, cents_of(sources["amount"]), days_of(sources["date"]).tolist(), strict=True))
            found = take_turns(asking, {None: pool}, pipeline, options)
            at = [pool.rows[k] for _, _, k, _, _ in found]
            if found:
                x, y = sources.iloc[[n for n, *_ in found]], targets.iloc[at]
                pairs = pd.DataFrame({f"{side}_{to}": e[c].to_numpy() for side, e in (("s", x), ("t", y)) for c, to in (("ordinal", "ordinal"), ("amount", "amount"), ("date", "date"))})
                yield pairs.assign(ref=key[0], currency=key[1], strategy=[name for *_, name, _ in found], score=[score_of(name, cost, options) for *_, name, cost in found])
                targets = targets.drop(index=at)
        if len(targets):
            state.update((targets["ordinal"].astype("int64").tolist(), targets["amount"].tolist(), targets["date"].tolist()))
            if wait_ms:
                state.setTimeoutDuration(wait_ms)
        elif state.exists:
            state.remove()

    kept = transactions.where("ref is not null and currency is not null and ordinal is not null").selectExpr("ref", "currency", "side", "ordinal", "cast(amount as decimal(18,2)) as amount", "value_date")
    return kept.groupBy(*KEY).applyInPandasWithState(step, _OUT, _STATE, "append", GroupStateTimeout.ProcessingTimeTimeout if wait_ms else GroupStateTimeout.NoTimeout)
