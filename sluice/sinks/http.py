"""HTTP sink with an injected transport."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

# A transport takes (method, url, headers, body) and returns (status code, body); it may raise.
Transport = Callable[[str, str, dict[str, str], bytes], tuple[int, str]]

RESULTS = (
    "array<struct<request:struct<method:string,url:string,headers:map<string,string>,body:binary>,"
    "response:struct<statusCode:int,body:string>,error:string,attempts:int,millis:bigint>>"
)

_REQUEST = pa.struct(
    [("method", pa.string()), ("url", pa.string()), ("headers", pa.map_(pa.string(), pa.string())), ("body", pa.binary())]
)
_RESULT = pa.struct(
    [
        ("request", _REQUEST),
        ("response", pa.struct([("statusCode", pa.int32()), ("body", pa.string())])),
        ("error", pa.string()),
        ("attempts", pa.int32()),
        ("millis", pa.int64()),
    ]
)


# How long one attempt may take, and how many messages of a batch are sent at a time.
TIMEOUT = 30.0
PARALLEL = 8


# Calls that their attempt gave up on and that have not come back: so many a worker process may have.
ABANDONED = 64
_abandoned = 0
_lock = threading.Lock()


class _Sender(threading.Thread):
    """Sends the requests of one message after another. When an attempt hangs it is left behind and another goes on in its place."""

    def __init__(self, sending: _Sending, place: tuple | None = None) -> None:
        super().__init__(daemon=True)
        self.sending, self.place = sending, place
        # when the attempt that is under way is over, and whether nobody waits for this sender any longer
        self.due: float | None = None
        self.left = False

    def run(self) -> None:
        self.sending.work(self)


class _Sending:
    """The requests of some messages, sent by a few threads for all of them; an attempt may take ``timeout`` seconds.

    A thread cannot be ended, so those left behind are counted until they come back, and there is a limit to them.
    """

    def __init__(self, messages: list[list[dict]], transport: Transport, attempts: int, backoff: float, timeout: float) -> None:
        self.transport, self.attempts, self.backoff, self.timeout = transport, attempts, backoff, timeout
        self.messages = messages
        self.results: list[list[tuple]] = [[] for _ in messages]
        self.waiting = iter(range(len(messages)))
        self.failure: BaseException | None = None
        self.senders: set[_Sender] = set()
        self.done = threading.Event()

    def all(self, parallel: int) -> list[list[tuple]]:
        """For each request its (response, error, attempts, millis)."""
        started = [_Sender(self) for _ in range(max(1, min(parallel, len(self.messages))))]
        self.senders = set(started)
        for sender in started:
            sender.start()
        while not self.done.wait(self._until_due()):
            started += self._leave_late()
        if self.failure is not None:
            raise self.failure
        for sender in started:
            if not sender.left:
                sender.join()
        return self.results

    def _until_due(self) -> float:
        with _lock:
            now = time.monotonic()
            return max(0.0, min([s.due for s in self.senders if s.due is not None], default=now + self.timeout) - now)

    def _leave_late(self) -> list[_Sender]:
        """Leave those behind whose attempt is over; returns who goes on in their place."""
        global _abandoned
        with _lock:
            now = time.monotonic()
            late = [s for s in self.senders if s.due is not None and s.due <= now]
            for sender in late:
                sender.left = True
                _abandoned += 1
                self.senders.remove(sender)
            following = [_Sender(self, (*s.place, f"TimeoutError: no response within {self.timeout:g} s")) for s in late]
            self.senders.update(following)
        for sender in following:
            sender.start()
        return following

    def work(self, sender: _Sender) -> None:
        try:
            if sender.place is not None:
                self._message(sender, *sender.place)
            while not sender.left and (n := next(self.waiting, None)) is not None:
                self._message(sender, n, 0, 0, 0.0, None)
        except BaseException as failure:
            self.failure = failure
        with _lock:
            self.senders.discard(sender)
            if not sender.left and (not self.senders or self.failure is not None):
                self.done.set()

    def _message(self, sender: _Sender, n: int, at: int, tried: int, started: float, error: str | None) -> None:
        """A message's requests from the one at ``at`` on, of which so many attempts have failed."""
        requests, results = self.messages[n], self.results[n]
        while at < len(requests):
            response = None
            if not tried:
                started, error = time.monotonic(), None
            while tried < self.attempts and response is None:
                if tried:
                    time.sleep(self.backoff * 2 ** (tried - 1))
                tried += 1
                sender.place = (n, at, tried, started)
                response, error = self._attempt(sender, requests[at])
                if sender.left:
                    return
            results.append((response, error, tried, int((time.monotonic() - started) * 1000)))
            at, tried = at + 1, 0

    def _attempt(self, sender: _Sender, request: dict) -> tuple[tuple | None, str | None]:
        global _abandoned
        with _lock:
            if _abandoned >= ABANDONED:
                return None, f"TooManyAbandoned: {_abandoned} calls have not come back"
            sender.due = time.monotonic() + self.timeout
        try:
            status, body = self.transport(request["method"], request["url"], dict(request["headers"] or []), request["body"])
            found = (status, body), None
        except Exception as failure:
            found = None, f"{type(failure).__name__}: {failure}"
        with _lock:
            sender.due = None
            if sender.left:
                _abandoned -= 1
        return found


def _send_one(request: dict, transport: Transport, attempts: int, backoff: float, timeout: float) -> dict:
    """Send with bounded retries; a failure becomes an error text, never an exception."""
    [[(response, error, tried, millis)]] = _Sending([[request]], transport, attempts, backoff, timeout).all(1)
    answer = None if response is None else {"statusCode": response[0], "body": response[1]}
    return {"request": request, "response": answer, "error": error, "attempts": tried, "millis": millis}


def _requests(flat: pa.StructArray) -> tuple[pa.StructArray, list[dict | None]]:
    """A batch's requests as the results repeat them, and as a transport takes them; both column by column."""
    columns = {f.name: (pc.struct_field(flat, f.name) if flat.type.get_field_index(f.name) >= 0 else pa.nulls(len(flat))).cast(f.type)
               for f in _REQUEST}
    maps = columns["headers"]
    names, values, ends = maps.keys.to_pylist(), maps.items.to_pylist(), maps.offsets.to_pylist()
    headers = [dict(zip(names[a:b], values[a:b])) for a, b in zip(ends, ends[1:])]
    plain = zip(columns["method"].to_pylist(), columns["url"].to_pylist(), headers, columns["body"].to_pylist())
    kept = pa.StructArray.from_arrays(list(columns.values()), fields=list(_REQUEST), mask=pc.is_null(flat))
    there = pc.is_valid(flat).to_pylist()
    return kept, [{"method": m, "url": u, "headers": h, "body": b} if is_there else None for is_there, (m, u, h, b) in zip(there, plain)]


def send_all(requests: Column, transport: Transport, attempts: int = 1, backoff: float = 0.5, timeout: float = TIMEOUT,
             parallel: int = PARALLEL) -> Column:
    """Send each row's requests and keep (request, response or error, attempts, millis) in the row.

    Results stay with their message, so no shuffle gathers them again. A message's requests are sent in
    order, those of ``parallel`` messages of a task at once; an attempt ends after ``timeout`` seconds.
    """

    @F.arrow_udf(RESULTS)
    def send(batch: pa.Array) -> pa.Array:
        counts = pc.fill_null(pc.list_value_length(batch), 0).to_pylist()
        kept, plain = _requests(batch.flatten())
        ends = list(accumulate(counts, initial=0))
        messages = [plain[a:b] for a, b in zip(ends, ends[1:])]
        found = [r for sent in _Sending(messages, transport, attempts, backoff, timeout).all(parallel) for r in sent]
        response = [None if r is None else {"statusCode": r[0], "body": r[1]} for r, *_ in found]
        columns = [kept, *(pa.array(c, f.type) for c, f in zip((response, *map(list, list(zip(*found))[1:] or [()] * 3)), list(_RESULT)[1:]))]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, fields=list(_RESULT)))

    return send.asNondeterministic()(requests)


def post_all(df: DataFrame, requests: str, transport: Transport, *, attempts: int = 1, backoff: float = 0.5,
             timeout: float = TIMEOUT, parallel: int = PARALLEL, results: str = "results") -> DataFrame:
    return df.withColumn(results, send_all(F.col(requests), transport, attempts, backoff, timeout, parallel))
