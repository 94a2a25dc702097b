"""Answer fragments, request metrics and ingest as streams."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from marlstone.operators.answers import LONGEST_HEADER, TOKENS
from marlstone.operators.ingest import replace_by_uri, replace_chunks
from marlstone.sources.files import complete_versions, read_corpus, replace_corpus, version_name


def assemble(fragments: DataFrame, patience: str = "15 minutes") -> DataFrame:
    """Whole completions from fragments (request_id, seq, ts, text, kind), whatever the cuts.

    A completion is emitted when its fragment of kind 'complete' is there and no number is missing; without one it is
    emitted as cut off when the watermark passes its last fragment by `patience`."""
    wait = int(pd.Timedelta(patience).total_seconds() * 1000)

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = dict(zip(*state.get)) if state.exists else {}
        texts = {int(k): v for k, v in held.items() if k >= 0}
        last = int(held.get(-1, -1) or -1)

        def whole(complete: bool) -> pd.DataFrame:
            state.remove()
            return pd.DataFrame({"request_id": [key[0]], "raw": ["".join(texts[k] for k in sorted(texts))], "complete": [complete]})

        if state.hasTimedOut:
            yield whole(False)
            return
        latest = 0
        for part in parts:
            for seq, ts, text, kind in zip(part["seq"], part["ts"], part["text"], part["kind"]):
                texts[int(seq)] = text or ""
                last = int(seq) if kind == "complete" else last
                latest = max(latest, int(ts.timestamp() * 1000))
        if last >= 0 and len(texts) == last + 1:
            yield whole(True)
            return
        state.update(([*texts, -1], [*texts.values(), str(last)]))
        state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs()) + wait)

    rows = fragments.withWatermark("ts", patience)
    return rows.groupBy("request_id").applyInPandasWithState(run, "request_id string, raw string, complete boolean", "seq array<long>, text array<string>", "append", GroupStateTimeout.EventTimeTimeout)


def verdict_events(fragments: DataFrame, patience: str = "15 minutes") -> DataFrame:
    """Verdicts of completions as they stream (request_id, verdict, provisional): the first line's as soon as it is whole,
    and, once the completion is, the last verdict line's if it overrides it. Fragments may come in any order."""
    wait = int(pd.Timedelta(patience).total_seconds() * 1000)

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seqs, texts, last, said = state.get if state.exists else ([], [], -1, None)
        held, latest, events = dict(zip(seqs, texts)), 0, []
        for part in parts:
            for seq, ts, text, kind in zip(part["seq"], part["ts"], part["text"], part["kind"]):
                held[int(seq)] = text or ""
                last = int(seq) if kind == "complete" else last
                latest = max(latest, int(ts.timestamp() * 1000))
        run_of = list(itertools.takewhile(lambda k: k in held, itertools.count()))
        lines = "".join(held[k] for k in run_of).split("\n")
        whole = last >= 0 and len(run_of) == last + 1
        if said is None and (len(lines) > 1 or whole):
            header = TOKENS.get(lines[0].strip()) if len(lines) > 1 and len(lines[0]) <= LONGEST_HEADER else None
            said = header or "error"
            events.append((key[0], said, True))
        if whole:
            final = [TOKENS[x.strip()] for x in lines[1:] if x.strip() in TOKENS]
            if final and final[-1] != said:
                events.append((key[0], final[-1], False))
            state.remove()
        else:
            state.update((list(held), list(held.values()), last, said))
            state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs()) + wait)
        if events:
            yield pd.DataFrame(events, columns=["request_id", "verdict", "provisional"])

    rows = fragments.withWatermark("ts", patience)
    return rows.groupBy("request_id").applyInPandasWithState(run, "request_id string, verdict string, provisional boolean", "seq array<long>, text array<string>, last long, said string", "append", GroupStateTimeout.EventTimeTimeout)


def _period(period: str):
    """The start of a timestamp's period as a column, and the end of a period by its start. Months are those of the calendar."""
    if "month" in period:
        months = int(period.split()[0])
        if months != 1:
            raise ValueError("calendar periods are of one month")
        return F.date_trunc("month", "ts"), lambda start: start + pd.DateOffset(months=1)
    return F.window("ts", period)["start"], lambda start: start + pd.Timedelta(period)


def spend_trips(rows: DataFrame, ceiling: float, period: str = "1 day", late: str = "15 minutes") -> DataFrame:
    """The row at which a source's spend in a period reaches the ceiling, once for each source and period: (period_start,
    source, spent, at). Rows: ts, source, cost_usd. A period is a length of time, or `1 month` of the calendar."""
    begin, end = _period(period)

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        spent, tripped = state.get if state.exists else (0.0, False)
        for part in parts:
            for ts, cost in part.sort_values("ts")[["ts", "cost_usd"]].itertuples(index=False):
                spent += float(cost or 0)
                if not tripped and spent >= ceiling:
                    tripped = True
                    yield pd.DataFrame({"period_start": [key[0]], "source": [key[1]], "spent": [spent], "at": [ts]})
        state.update((spent, tripped))
        over = end(pd.Timestamp(key[0])) + pd.Timedelta(late)
        state.setTimeoutTimestamp(max(int(over.timestamp() * 1000), state.getCurrentWatermarkMs() + 1))

    keyed = rows.withWatermark("ts", late).select(begin.alias("period_start"), "ts", "source", F.col("cost_usd").cast("double").alias("cost_usd"))
    return keyed.groupBy("period_start", "source").applyInPandasWithState(run, "period_start timestamp, source string, spent double, at timestamp", "spent double, tripped boolean", "append", GroupStateTimeout.EventTimeTimeout)


def budget_trips(rows: DataFrame, daily: float, monthly: float, late: str = "1 day", visitor: str = "visitor") -> DataFrame:
    """Where spend reaches a ceiling, as it streams: (cause, period_start, spent, at), once for each month and day.

    All spend counts for the calendar month, that of visitors for the day. The month outranks the day: from the row on at
    which it is reached no day of it trips any more. A month's state goes when the month and `late` are over."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        month, month_over, days, sums, day_over = state.get if state.exists else (0.0, False, [], [], [])
        spent, over = dict(zip(days, sums)), set(day_over)
        trips = []
        rows = pd.concat(list(parts)).sort_values("ts", kind="stable")
        for ts, source, cost in rows[["ts", "source", "cost_usd"]].itertuples(index=False):
            cost = 0.0 if pd.isna(cost) else float(cost)
            day = str(ts.date())
            month += cost
            if source == visitor:
                spent[day] = spent.get(day, 0.0) + cost
            if not month_over and month >= monthly:
                month_over = True
                trips.append(("monthly", key[0], month, ts))
            elif not month_over and source == visitor and day not in over and spent[day] >= daily:
                over.add(day)
                trips.append(("daily", pd.Timestamp(day), spent[day], ts))
        state.update((month, month_over, list(spent), list(spent.values()), sorted(over)))
        end = pd.Timestamp(key[0]) + pd.DateOffset(months=1) + pd.Timedelta(late)
        state.setTimeoutTimestamp(max(int(end.timestamp() * 1000), state.getCurrentWatermarkMs() + 1))
        if trips:
            yield pd.DataFrame(trips, columns=["cause", "period_start", "spent", "at"])

    keyed = rows.withWatermark("ts", late).select(F.date_trunc("month", "ts").alias("month"), "ts", "source", F.col("cost_usd").cast("double").alias("cost_usd"))
    state = "month double, month_over boolean, days array<string>, sums array<double>, day_over array<string>"
    return keyed.groupBy("month").applyInPandasWithState(run, "cause string, period_start timestamp, spent double, at timestamp", state, "append", GroupStateTimeout.EventTimeTimeout)


def silent_series(requests: DataFrame, silence: str, late: str = "15 minutes", key: str = "route") -> DataFrame:
    """Series that have gone quiet: (key, last_seen), once for each pause. A timer is set `silence` behind the last event of
    each series and fires when the watermark passes it without another event having come; a pause that an event of the next
    batch ends is told when that comes."""
    wait = int(pd.Timedelta(silence).total_seconds() * 1000)

    def run(name: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else 0
        if state.hasTimedOut:
            state.remove()
            yield told(name, [last])
            return
        pauses = []
        for ts in sorted(int(t.timestamp() * 1000) for part in parts for t in part["ts"]):
            if last and ts - last > wait:
                pauses.append(last)
            last = max(last, ts)
        state.update((last,))
        state.setTimeoutTimestamp(max(last + wait, state.getCurrentWatermarkMs() + 1))
        if pauses:
            yield told(name, pauses)

    def told(name: tuple, pauses: list[int]) -> pd.DataFrame:
        return pd.DataFrame({key: [name[0]] * len(pauses), "last_seen": pd.to_datetime(pauses, unit="ms")})

    kind = requests.schema[key].dataType.simpleString()
    return requests.withWatermark("ts", late).select(key, "ts").groupBy(key).applyInPandasWithState(run, f"{key} {kind}, last_seen timestamp", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def tumbling_metrics(requests: DataFrame, late: str = "15 minutes") -> DataFrame:
    """Requests, failures and pressure by route and quarter of an hour."""
    n = lambda c: F.count(F.when(c, 1))
    rows = requests.withWatermark("ts", late).groupBy("route", F.window("ts", "15 minutes"))
    return rows.agg(F.count(F.lit(1)).alias("n"), n(F.col("status") >= 500).alias("failures"), n(F.col("status") == 429).alias("pressure"))


def sliding_alerts(requests: DataFrame, late: str = "15 minutes") -> DataFrame:
    """The same failures over quarters of an hour that begin every minute."""
    rows = requests.withWatermark("ts", late).groupBy(F.window("ts", "15 minutes", "1 minute"))
    out = rows.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("status") >= 500, 1)).alias("failures"))
    return out.withColumn("fires", F.col("failures") > 0)


def idle_sessions(events: DataFrame, gap: str, late: str = "15 minutes") -> DataFrame:
    """Runs of events of a request without a pause of `gap`."""
    return events.withWatermark("ts", late).groupBy("request_id", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n"))


def once_per_request(rows: DataFrame, late: str = "15 minutes") -> DataFrame:
    """At most one ledger row a request."""
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(["request_id"])


def running_spend(rows: DataFrame, late: str = "15 minutes") -> DataFrame:
    """Spend by UTC day and source, updated as rows come; a consumer compares it with the ceilings."""
    return rows.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "source").agg(F.sum("cost_usd").alias("spent"))


def ingest(files: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str):
    """New files by micro-batch through `apply`, which replaces documents by uri; ends when all that is there is done."""
    return files.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_corpus(files: DataFrame, parse: Callable[[DataFrame], tuple[DataFrame, DataFrame]], path: str, checkpoint: str):
    """New files by micro-batch into versions of a corpus, each committed once.

    `parse` gives documents (source_uri, content_hash, ...) and chunks (source_uri, ...) of a batch's files. Unchanged
    documents are skipped, changed ones replaced by uri, chunks with them. A batch's number names its version, and its marker
    is written last: a batch that comes again after a crash in between writes the version anew, one that was committed
    writes nothing."""

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        version = version_name(number)
        if version in complete_versions(spark, path):
            return
        documents, chunks = parse(batch)
        before = read_corpus(spark, path)
        if before is None:
            before = tuple(spark.createDataFrame([], df.schema) for df in (documents, chunks))
        kept = replace_by_uri(before[0], documents), replace_chunks(before[1], chunks, before[0], documents)
        replace_corpus(*kept, path, version)

    return ingest(files, apply, checkpoint)
