"""Keyed event state for streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.sources.events import CART, ORDER, SESSION

# Money is kept in whole hundred-millionths.
UNITS = 100_000_000
STATE_SCHEMA = "carts bigint, cart_value double, orders bigint, units bigint, sessions bigint, cart_at bigint, cart_id bigint"
OUTPUT_SCHEMA = (
    "event_id bigint, ts timestamp_ntz, customer_id bigint, event_type string, amount double, "
    "cart_abandoned_count bigint, last_cart_value double, order_count bigint, "
    "monetary double, session_count bigint"
)
EMPTY = (0, None, 0, 0, 0, None, None)


class CustomerState(StatefulProcessor):
    """Counters and last cart value per customer; one output row per event.

    Events of one trigger are applied in (ts, event_id) order. Counters do not depend on
    the order; an older cart arriving in a later trigger does not replace a newer value.
    """

    def __init__(self, ttl_ms: int | None = None) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", STATE_SCHEMA, self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True).sort_values(["ts", "event_id"])
        stored = self.state.get() if self.state.exists() else EMPTY
        carts, value, orders, units, sessions, cart_at, cart_id = stored
        history = []
        for event_id, ts, kind, amount in zip(
            batch["event_id"], batch["ts"], batch["event_type"], batch["amount"], strict=True
        ):
            amount = 0.0 if pd.isna(amount) else float(amount)
            if kind == CART:
                carts += 1
                at = (ts.value, int(event_id))
                if cart_at is None or at >= (cart_at, cart_id):
                    value, (cart_at, cart_id) = amount, at
            elif kind == ORDER:
                orders += 1
                units += round(amount * UNITS)
            elif kind == SESSION:
                sessions += 1
            history.append((carts, value, orders, units / UNITS, sessions))
        self.state.update((carts, value, orders, units, sessions, cart_at, cart_id))
        out = batch[["event_id", "ts"]].assign(
            customer_id=key[0], event_type=batch["event_type"], amount=batch["amount"]
        )
        names = ["cart_abandoned_count", "last_cart_value", "order_count", "monetary", "session_count"]
        after = pd.DataFrame(history, columns=names, index=batch.index)
        after["last_cart_value"] = after["last_cart_value"].astype(float)
        yield pd.concat([out, after], axis=1)

    def close(self) -> None:
        pass


def stream_state(events: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """State after every event of a stream; needs the RocksDB state store provider."""
    return events.groupBy("customer_id").transformWithStateInPandas(
        statefulProcessor=CustomerState(ttl_ms),
        outputStructType=OUTPUT_SCHEMA,
        outputMode="Append",
        timeMode="ProcessingTime" if ttl_ms else "None",
    )
