"""Stateful processors with event-time timers. Classes are made inside functions, so that they travel to the workers whole and nothing needs to be
installed there. Stamps are milliseconds since 1970; sums are kept, never rows."""

from __future__ import annotations

VERDICT = "fid {key}, n long, rmse double, rejected boolean, closed_by string"
UNIT_MEANS = "fid {key}, variable string, bucket timestamp, mean double, n long, latest timestamp"


def rocksdb(spark) -> None:
    """Processors with timers need this state store; a provider that the session has set is left alone."""
    name, plain = "spark.sql.streaming.stateStore.providerClass", "HDFSBackedStateStoreProvider"
    if plain in spark.conf.get(name, plain):
        spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def verdicts(threshold: float, timeout_ms: int):
    """Judges each run once. Input: fid, at, ends_at (its last stamp, or NULL), error. State: count, sum of squares and latest stamp of a run; one
    timer at its end stamp, or ``timeout_ms`` after its latest row if that is sooner. When the watermark passes the timer, the verdict is
    given and the sums are dropped. What comes for a judged run is left out: after its end by comparing stamps, after a timeout by a mark that is kept until its end."""
    import pandas as pd
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    class Verdicts(StatefulProcessor):
        def init(self, handle):
            self.handle = handle
            self.sums = handle.getValueState("sums", "n long, squares double, latest long, ends_at long, timer long")
            self.judged = handle.getValueState("judged", "closed_by string")

        def handleInputRows(self, key, rows, timerValues):
            n, squares, latest, ends_at, timer = self.sums.get() if self.sums.exists() else (0, 0.0, None, None, None)
            now, seen = timerValues.getCurrentWatermarkInMs(), False
            for part in rows:
                ends = part["ends_at"].dropna()
                ends_at = int(ends.max()) if len(ends) else ends_at
                if self.judged.exists() or ends_at is not None and ends_at <= now:
                    continue
                part = part if ends_at is None else part[part["at"] <= ends_at]
                if len(part):
                    n, squares, seen = n + len(part), squares + float((part["error"] ** 2).sum()), True
                    latest = max(int(part["at"].max()), latest if latest is not None else int(part["at"].max()))
            if seen:
                due = max(min(latest + timeout_ms, ends_at if ends_at is not None else latest + timeout_ms), now + 1)
                if due != timer:
                    if timer is not None:
                        self.handle.deleteTimer(timer)
                    self.handle.registerTimer(due)
                self.sums.update((n, squares, latest, ends_at, due))
            return iter(())

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            if not self.sums.exists():  # the end of a run that had been closed by its timeout
                self.judged.clear()
                return
            n, squares, _, ends_at, _ = self.sums.get()
            self.sums.clear()
            ended = ends_at is not None and ends_at <= timerValues.getCurrentWatermarkInMs()
            if not ended:
                self.judged.update(("timeout",))
                if ends_at is not None:
                    self.handle.registerTimer(ends_at)
            rmse = (squares / n) ** 0.5
            yield pd.DataFrame({"fid": [key[0]], "n": [n], "rmse": [rmse], "rejected": [rmse > threshold], "closed_by": ["end" if ended else "timeout"]})

        def close(self):
            pass

    return Verdicts()


def unit_means():
    """Means of calendar units of any length. Input: fid, variable, bucket, at, ends_at (the unit's end), value. State: count, sum and latest stamp of
    a unit, dropped when the watermark passes the unit's end; rows of such units are left out."""
    import pandas as pd
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    class UnitMeans(StatefulProcessor):
        def init(self, handle):
            self.handle = handle
            self.sums = handle.getValueState("sums", "n long, total double, latest long")

        def handleInputRows(self, key, rows, timerValues):
            n, total, latest = self.sums.get() if self.sums.exists() else (0, 0.0, None)
            fresh, ends_at = not self.sums.exists(), None
            for part in rows:
                if not len(part):
                    continue
                ends_at, at = int(part["ends_at"].iloc[0]), int(part["at"].max())
                values = part["value"].dropna()
                n, total = n + len(values), total + float(values.sum())
                latest = at if latest is None else max(latest, at)
            if ends_at is None or ends_at <= timerValues.getCurrentWatermarkInMs():
                return
            if fresh:
                self.handle.registerTimer(ends_at)
            self.sums.update((n, total, latest))
            yield pd.DataFrame({"fid": [key[0]], "variable": [key[1]], "bucket": [key[2]], "mean": [total / n if n else None], "n": [n], "latest": pd.to_datetime([latest], unit="us")})

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            self.sums.clear()
            return iter(())

        def close(self):
            pass

    return UnitMeans()
