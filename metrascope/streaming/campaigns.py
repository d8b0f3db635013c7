"""A ledger of spending campaigns as arbitrary state by key, from a stream of their events.

Each campaign is created once, with a cap; requests reserve against it and are
settled; it is amended, and closed for good once no reservation is open. Every
event gives a row: taken, or refused with the reason, and what the campaign
comes to after it. The state of a campaign is its header and its open
reservations by request, one value in the state store, so a lost executor costs
a batch that is tried again. A batch reads and writes it once, and a task holds
the open reservations of one campaign at a time.

Events of a micro-batch are taken in the order of ``seq``; one that comes in a
later batch than events after it is told as late, and refused, as what
followed was decided without it.

Defined results: repeated events are refused as what they are (a second
creation, a known request, a request that is not open); an event of unknown
kind, or without an amount where one is needed, is refused; a null cap is none.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

EVENT = "campaign string, seq long, kind string, request string, usd double"
OUTCOME = "campaign string, seq long, kind string, taken boolean, reason string, status string, used double, open int"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def judge(header: tuple, reserved: float | None, n_open: int, seq: int, kind: str, usd: float | None) -> tuple[str | None, tuple, int]:
    """(reason to refuse, header after, change of the number of open reservations) of one event.

    ``header``: status (None if unknown), cap, used, last seq; ``reserved``: what the event's request has reserved, None if it is not open.
    """
    status, cap, used, last = header
    reason = None
    if last is not None and seq < last:
        reason = "late"
    elif kind == "created":
        reason = "exists" if status is not None else None
    elif status is None:
        reason = "unknown campaign"
    elif kind not in ("amended", "reserved", "settled", "closed"):
        reason = "unknown kind"
    elif status == "closed" and kind != "amended":
        reason = "closed"
    elif kind in ("reserved", "settled") and usd is None:
        reason = "no amount"
    elif kind == "reserved":
        reason = "repeated request" if reserved is not None else "over the cap" if cap is not None and used + usd > cap else None
    elif kind == "settled":
        reason = "not open" if reserved is None else None
    elif kind == "closed":
        reason = "open reservations" if n_open else None
    if reason is not None:
        return reason, (status, cap, used, last if last is not None and last > seq else seq if status is not None else last), 0
    if kind == "created":
        return None, ("open", usd, 0.0, seq), 0
    if kind == "reserved":
        return None, (status, cap, used + usd, seq), 1
    if kind == "settled":
        return None, (status, cap, used + usd - reserved, seq), -1
    return None, ("closed" if kind == "closed" else status, cap, used, seq), 0


class Campaigns(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "status string, cap double, used double, last long, open map<string,double>")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # Every access to the state store is a message to another process, so a batch reads and writes a campaign's state once.
        *header, held = self.state.get() or (None, None, 0.0, None, {})
        header, held, told = tuple(header), dict(held), Row(*[c.split()[0] for c in OUTCOME.split(", ")])
        # A key's events of one micro-batch; how many files make a batch bounds them.
        for seq, kind, request, usd in sorted((tuple(r[1:]) for r in rows), key=lambda e: (e[0], e[1] is not None, e[1], e[2] is not None, e[2])):
            request, usd = request or "", None if usd is None or usd != usd else usd
            reason, header, change = judge(header, held.get(request) if kind in ("reserved", "settled") else None, len(held), seq, kind, usd)
            if change > 0:
                held[request] = usd
            elif change < 0:
                del held[request]
            yield told(key[0], seq, kind, reason is None, reason, header[0], header[2], len(held))
        self.state.update((*header, held))

    def close(self) -> None:
        pass


def campaign_ledger(events: DataFrame) -> DataFrame:
    """The outcomes (``OUTCOME``) of a stream of events (``EVENT``), in append mode."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)  # the store that this kind of state needs
    keyed = events.select(*[c.split()[0] for c in EVENT.split(", ")]).groupBy("campaign")
    return keyed.transformWithState(statefulProcessor=Campaigns(), outputStructType=OUTCOME, outputMode="Append", timeMode="None")
