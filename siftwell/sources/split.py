"""Tables inside files that have no safe place to cut: quoted CSV and arrays of JSON objects.

A file is cut into byte ranges anywhere.  The first pass runs each range from every state that
it may begin in (inside of quotes or not, and so on) and keeps the state in which it ends; a
range is thus a small function of states, and functions of consecutive ranges compose.  The
states at all cuts follow from the first, and the second pass reads each range once more in
its true state and gives the records that begin there, reading on to the end of the last.
A task holds one range and one record.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.sources import scratch
from siftwell.sources.ranges import Ahead, Ranged, by_range, dealt

STEP = 4 * 1024 * 1024


def strings(df: DataFrame):
    """A DataFrame of one string column as a Dataset that Spark's text readers take."""
    jvm = df.sparkSession._jvm
    return getattr(df._jdf, "as")(jvm.org.apache.spark.sql.Encoders.STRING())


def states_at_cuts(ends: DataFrame, first: int = 0) -> DataFrame:
    """(path, start, stop, state) from (path, start, stop, ends), where ends[s] is the state after the range if it begins in state s; a row a range."""
    listed = ends.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("start", "ends", "stop"))).alias("of"))
    zero = F.struct(F.lit(first).alias("state"), F.array().cast("array<struct<start:bigint,stop:bigint,state:int>>").alias("found"))
    step = lambda at, x: F.struct(F.element_at(x["ends"], at["state"] + 1).alias("state"), F.concat(at["found"], F.array(F.struct(x["start"].alias("start"), x["stop"].alias("stop"), at["state"].alias("state")))).alias("found"))
    return listed.select("path", F.explode(F.aggregate("of", zero, step, lambda at: at["found"])).alias("f")).select("path", "f.start", "f.stop", "f.state")


def kept(states: DataFrame) -> DataFrame:
    """The states, or records, as a table in the shared folder, so that ranges are scanned once whatever reads them."""
    path = f"{scratch.new_folder(states.sparkSession)}/states"
    states.write.parquet(path)
    return states.sparkSession.read.schema(states.schema).parquet(path)


# --- CSV

#: States at a byte: a record begins, a field begins, in a bare field, in quotes, behind a quote that ends them or is the first of two.
RECORD, FIELD, BARE, QUOTED, BEHIND = range(5)


class Csv:
    """Patterns of one delimiter. A field is quoted if a quote is its first byte; two quotes inside stand for one."""

    def __init__(self, delimiter: str) -> None:
        d = re.escape(delimiter.encode())
        bare = rb"[^" + d + rb"\n]*+"
        field = rb'(?:"(?:[^"]++|"")*+"' + bare + rb'|[^"' + d + rb"\n]" + bare + rb")?+"
        line = field + rb"(?:" + d + field + rb")*+\n"
        self.rest, self.line, self.lines = re.compile(bare), re.compile(line), re.compile(rb"(?:" + line + rb")*+")
        self.fields, self.inside = re.compile(rb"(?:" + field + d + rb")*+"), re.compile(rb'(?:[^"]++|"")*+')

    def begin(self, data: bytes, state: int) -> tuple[int, int]:
        """(place, state) where the first field or record begins, or the end of data and the state there."""
        at = 0
        if state == BEHIND:
            if data[:1] == b'"':
                at, state = 1, QUOTED
            else:
                state = BARE
        if state == QUOTED:
            at = self.inside.match(data, at).end()
            if at == len(data):
                return at, QUOTED
            at, state = at + 1, BARE
            if at == len(data):
                return at, BEHIND
        if state == BARE:
            at = self.rest.match(data, at).end()
            if at == len(data):
                return at, BARE
            state = RECORD if data[at : at + 1] == b"\n" else FIELD
            at += 1
        return at, state

    def first_record(self, data: bytes, state: int) -> tuple[int | None, int]:
        """The place of the first record that begins in data, if one does, and else the state at its end."""
        at, state = self.begin(data, state)
        if state == RECORD:
            return at, state
        if state == FIELD and at < len(data):
            found = self.line.match(data, at)
            return (found.end(), RECORD) if found else (None, self.end(data, at, FIELD))
        return None, state

    def end(self, data: bytes, at: int, state: int) -> int:
        """The state at the end of data, which holds no whole record from ``at`` on."""
        to = self.fields.match(data, at).end()
        if to == len(data):
            return FIELD if to > at else state
        if data[to : to + 1] != b'"':
            return BARE
        last = self.inside.match(data, to + 1).end()
        return QUOTED if last == len(data) else BEHIND if last == len(data) - 1 else BARE

    def ends(self, data: bytes) -> list[int]:
        """The state at the end for each state at the beginning."""
        out, known = [], {}
        for state in range(5):
            at, after = self.first_record(data, state)
            if at is not None and at not in known:
                to = self.lines.match(data, at).end()
                known[at] = RECORD if to == len(data) else self.end(data, to, RECORD)
            out.append(after if at is None else known[at])
        return out

    def records(self, file: Ranged, start: int, stop: int, state: int, more: int = 1 << 12) -> Iterator[tuple[int, bytes]]:
        """(place, record) of the records that begin in the range."""
        data = file.range(start, stop)
        at, _ = self.first_record(data, state)
        while at is not None and start + at < stop:
            found = self.line.match(data, at)
            if found:
                yield start + at, found[0][:-1]
                at = found.end()
                continue
            extra = file.range(start + len(data), start + len(data) + more)
            if not extra:
                yield start + at, data[at:]
                return
            # what is read so far of the last record stays; as much again is read each time
            data, start, at, more = data[at:] + extra, start + at, 0, 2 * more


def opened(ranges: Iterator[tuple]) -> Iterator[tuple]:
    """(file, start, …) of ranges (path, start, …): a file stays open, and about 2 MB of it at hand, while ranges of it follow each other."""
    file = None
    try:
        for path, *rest in ranges:
            if file is None or file.path != path:
                if file is not None:
                    file.close()
                file = Ahead(path)
            yield file, *rest
    finally:
        if file is not None:
            file.close()


def scanned(cuts: DataFrame, work: Callable[[Ranged, int, int], list[int]]) -> DataFrame:
    """(path, start, stop, ends) of ranges."""

    def look(batches):
        for batch in batches:
            ends = [work(file, start, stop) for file, start, stop in opened(zip(*[c.to_pylist() for c in batch.columns], strict=True))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ends, pa.list_(pa.int32()))], names=["path", "start", "stop", "ends"])

    return cuts.mapInArrow(look, "path string, start long, stop long, ends array<int>")


def given(cuts: DataFrame, work: Callable[[Ranged, int, int, int], Iterator[tuple[int, bytes]]], encoding: str = "utf-8") -> DataFrame:
    """(path, at, value) of the records that begin in ranges (path, start, stop, state), in batches of about 4 MB."""

    def sent(held: list[tuple[str, int, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([p for p, _, _ in held], pa.string()), pa.array([a for _, a, _ in held], pa.int64()), pa.array([v.decode(encoding, "replace") for _, _, v in held], pa.string())], names=["path", "at", "value"])

    def look(batches):
        for batch in batches:
            held, size = [], 0
            for file, start, stop, state in opened(zip(*[c.to_pylist() for c in batch.columns], strict=True)):
                for at, value in work(file, start, stop, state):
                    held.append((file.path, at, value))
                    size += len(value)
                    if size > 4 << 20:
                        yield sent(held)
                        held, size = [], 0
            yield sent(held)

    return cuts.select("path", "start", "stop", "state").mapInArrow(look, "path string, at long, value string")


def without_mark(file: Ranged, start: int, stop: int) -> tuple[int, int]:
    """The range without the UTF-8 mark that a file may begin with; empty if it is part of it."""
    skip = 3 if start < 3 and file.range(0, 3) == b"\xef\xbb\xbf" else 0
    return max(start, skip), max(stop, skip)


def csv_records(files: DataFrame, delimiter: str, encoding: str = "utf-8", step: int = STEP) -> DataFrame:
    """(path, at, value): every record of delimited files (path, length), without its line end; the header's place is 0."""
    made = Csv(delimiter)
    cuts = by_range(files, step)

    def ends(file: Ranged, start: int, stop: int) -> list[int]:
        start, stop = without_mark(file, start, stop)
        return made.ends(file.range(start, stop)) if start < stop else list(range(5))

    def work(file: Ranged, start: int, stop: int, state: int) -> Iterator[tuple[int, bytes]]:
        start, stop = without_mark(file, start, stop)
        head = start if start <= 3 and state == RECORD else None
        if start < stop:
            for at, record in made.records(file, start, stop, state):
                yield 0 if at == head and (at == 0 or file.range(0, 3) == b"\xef\xbb\xbf") else at, record.removesuffix(b"\r")

    return given(dealt(kept(states_at_cuts(scanned(cuts, ends))), files, step), work, encoding)


def read_csv(spark: SparkSession, files: DataFrame, options: dict[str, str], encoding: str = "utf-8", step: int = STEP) -> DataFrame:
    """The table of delimited files (path, length) whose first records are headers, as Spark's reader of whole files gives it.

    Spark infers the types and parses the records; only where records begin is found here."""
    options = options | {"header": "false", "multiLine": "true"}
    first = files.where("length > 0").orderBy("path").limit(1).collect()
    head = ""
    if first:
        with Ranged(first[0].path) as file:
            start, stop = without_mark(file, 0, file.size)
            head = next((r for _, r in Csv(options["sep"]).records(file, start, min(stop, 65536), RECORD)), b"").removesuffix(b"\r").decode(encoding, "replace")
    if not head:
        return spark.createDataFrame([], "value string").drop("value")
    records = csv_records(files, options["sep"], encoding, step)
    names = header(spark, head, options)
    body = records.where("at > 0 and value <> ''").select("value")
    blank = spark.createDataFrame([(options["sep"] * (len(names) - 1),)], "value string")
    given_types = spark.read.options(**options)._jreader.csv(strings(blank.unionAll(body)))
    types = [f.dataType for f in DataFrame(given_types, spark).schema][: len(names)]
    parsed = body.select(F.from_csv("value", ", ".join(f"c{i} {t.simpleString()}" for i, t in enumerate(types)), options).alias("r"))
    return parsed.select(*[F.col(f"r.c{i}").alias(n) for i, n in enumerate(names)])


def header(spark: SparkSession, line: str, options: dict[str, str]) -> list[str]:
    """Names of columns as Spark makes them of a header: unnamed ones by place, repeated ones with their place."""
    one = spark.createDataFrame([(line,)], "value string")
    return DataFrame(spark.read.options(**{k: v for k, v in options.items() if k != "inferSchema"} | {"header": "true"})._jreader.csv(strings(one)), spark).columns


# --- JSON

#: States of a byte in JSON: outside of strings, in one, in one behind a backslash. A state at a cut is this plus three times the depth.
OUT, IN, ESCAPED = range(3)
SPACE = np.isin(np.arange(256), list(b" \t\r\n,"))


def signs(data: bytes, state: int, every: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Places of brackets outside of strings (every: of all) and what they add to the depth, places of quotes, and the state at the end."""
    raw = np.frombuffer(data, np.uint8)
    first = 1 if state == ESCAPED else 0
    quotes = np.flatnonzero(raw == 0x22)
    slashes = raw == 0x5C
    if first:
        slashes[0], quotes = False, quotes[quotes > 0]
    others = np.flatnonzero(~slashes)

    def run(at: np.ndarray) -> np.ndarray:
        """How many backslashes stand right before."""
        k = np.searchsorted(others, at) - 1
        return at - 1 - np.where(k >= 0, others[k] if len(others) else -1, -1)

    quotes = quotes[run(quotes) % 2 == 0] if len(quotes) else quotes
    inside = int(state != OUT)
    brackets = np.flatnonzero((raw == 0x7B) | (raw == 0x5B) | (raw == 0x7D) | (raw == 0x5D))
    if not every:
        brackets = brackets[(np.searchsorted(quotes, brackets) + inside) % 2 == 0]
    add = np.where((raw[brackets] == 0x7B) | (raw[brackets] == 0x5B), 1, -1)
    end = (len(quotes) + inside) % 2
    if end and run(np.array([len(raw)]))[0] % 2:
        end = ESCAPED
    return brackets, add, quotes, int(end)


def json_ends(data: bytes) -> list[int]:
    """For each state of a string: three times the change of depth, plus the state of a string, at the end."""
    brackets, _, quotes, end = signs(data, OUT, True)
    raw = np.frombuffer(data, np.uint8)[brackets]
    add = np.where((raw == 0x7B) | (raw == 0x5B), 1, -1)
    odd = np.searchsorted(quotes, brackets) % 2 == 1
    inner, outer = int(add[odd].sum()), int(add.sum())
    # the quotes are the same in and out of a string; so they are behind a backslash, unless the first byte is a quote or one
    slashes = len(data) - len(data.rstrip(b"\\"))
    inside = len(quotes) % 2 == 0
    last = (ESCAPED if slashes % 2 else IN) if inside else OUT
    out = [3 * (outer - inner) + end, 3 * inner + last]
    if data[:1] in (b'"', b"\\"):
        _, more, _, last = signs(data, ESCAPED)
        return [*out, 3 * int(more.sum()) + last]
    return [*out, out[1]]


def depths_at_cuts(ends: DataFrame) -> DataFrame:
    """(path, start, stop, state): as states_at_cuts, but depths add up."""
    listed = ends.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("start", "ends", "stop"))).alias("of"))
    zero = F.struct(F.lit(0).alias("state"), F.array().cast("array<struct<start:bigint,stop:bigint,state:int>>").alias("found"))
    after = lambda at, x: at["state"] - F.pmod(at["state"], F.lit(3)) + F.element_at(x["ends"], F.pmod(at["state"], F.lit(3)) + 1)
    step = lambda at, x: F.struct(after(at, x).cast("int").alias("state"), F.concat(at["found"], F.array(F.struct(x["start"].alias("start"), x["stop"].alias("stop"), at["state"].alias("state")))).alias("found"))
    return listed.select("path", F.explode(F.aggregate("of", zero, step, lambda at: at["found"])).alias("f")).select("path", "f.start", "f.stop", "f.state")


def json_objects(file: Ranged, start: int, stop: int, state: int, more: int = 1 << 12) -> Iterator[tuple[int, bytes]]:
    """(place, text) of the objects that begin in the range and are items of the outermost list; (-1, text) for an item that is none."""
    data = file.range(start, stop)
    brackets, add, quotes, _ = signs(data, state % 3)
    depth = state // 3 + np.cumsum(add)
    raw = np.frombuffer(data, np.uint8)
    begins = brackets[(add == 1) & (depth == 2)]
    if (raw[begins] != 0x7B).any():
        yield -1, data[int(begins[raw[begins] != 0x7B][0]) :][:20]
    ends = brackets[(add == -1) & (depth == 1)] + 1
    # items of depth one that are neither objects nor lists
    level = np.zeros(len(raw) + 1, np.int64)
    np.add.at(level, brackets + (add == 1), add)
    loose = np.flatnonzero((np.cumsum(level[:-1]) + state // 3 == 1) & ~SPACE[raw] & ~np.isin(raw, list(b"[]{}")))
    if len(loose):
        yield -1, data[int(loose[0]) :][:20]
    whole = np.searchsorted(ends, begins, "right")
    for at, k in zip(begins.tolist(), whole.tolist(), strict=True):
        if k < len(ends):
            yield start + at, data[at : int(ends[k])]
            continue
        held = data[at:]
        while True:
            places, change, _, _ = signs(held, OUT)
            closed = np.flatnonzero(np.cumsum(change) == 0)
            if len(closed):
                yield start + at, held[: int(places[closed[0]]) + 1]
                break
            extra = file.range(start + at + len(held), start + at + len(held) + more)
            if not extra:
                yield -1, held[:20]
                break
            held, more = held + extra, 2 * more


def json_records(files: DataFrame, step: int = STEP) -> DataFrame:
    """(path, at, value): the objects in the outermost lists of JSON files (path, length); a row with ``at`` -1 says that something else is in one."""
    cuts = by_range(files, step)
    ends = scanned(cuts, lambda file, start, stop: json_ends(file.range(start, stop)))
    return given(dealt(kept(depths_at_cuts(ends)), files, step), json_objects)


def read_json(spark: SparkSession, files: DataFrame, step: int = STEP) -> DataFrame | None:
    """The table of JSON files that are lists of objects; None if anything else is in a list."""
    # three steps need the records: whether they are objects, their types, and the table
    records = kept(json_records(files, step))
    odd = records.select((F.col("at") < 0).alias("odd")).agg(F.max("odd")).first()[0]
    if odd is not False:
        return None
    found = DataFrame(spark.read._jreader.json(strings(records.select("value"))), spark)
    return found if found.columns else None
