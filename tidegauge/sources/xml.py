"""Tables in light-weight XML documents: <Table> elements with <Column> declarations and a delimited <Stream>.

Files of up to ``WHOLE`` bytes are parsed whole, one a task. Of larger ones the
driver gets the lines with markup, which tell where the streams lie; the
streams are read in blocks. Lines of a stream have no raw ``<``, so this holds
for all documents whose tags and comments end on the line that they start on;
others are parsed whole, as are those with CDATA sections, entities of their
own, another encoding than UTF-8, or odd delimiters.
"""

from __future__ import annotations

import html
import io
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from typing import Any
from xml.etree import ElementTree
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.sources.lines import Block, from_states, read_lines, summaries, write_numbered
from tidegauge.sources.registry import register

#: Column types of the format, and Spark's.
TYPES = {"int_2s": "short", "int_2u": "int", "int_4s": "int", "int_4u": "long", "int_8s": "long", "int_8u": "decimal(20,0)", "int": "int", "real_4": "float", "real_8": "double", "float": "float", "double": "double", "lstring": "string", "char_s": "string", "char_v": "string", "ilwd:char": "string"}


def _bare(name: str) -> str:
    return name.split(":")[-1].removesuffix(":table")


def _table_name(name: str) -> str:
    parts = [p for p in name.split(":") if p != "table"]
    return parts[-1]


def _values(text: str, delimiter: str) -> Iterator[str | None]:
    """The values of a stream: null where nothing is between delimiters; in quotes, a backslash keeps the character after it."""
    d, text = re.escape(delimiter), text.rstrip()
    for m in re.finditer(rf'\s*(?:"((?:[^"\\]|\\.)*)"|([^{d}"]*?))\s*(?:{d}|\Z)', text, re.DOTALL):
        if m.start() == len(text) and (not text or text.endswith(delimiter)):
            return
        yield re.sub(r"\\(.)", r"\1", m[1], flags=re.DOTALL) if m[1] is not None else m[2] or None
        if m.end() == len(text) and not text.endswith(delimiter):
            return


def _tables(content: bytes, wanted: str | None, streams: bool) -> Iterator[tuple[str, list[tuple[str, str]], list[list[str | None]]]]:
    root = ElementTree.parse(io.BytesIO(content)).getroot()
    for t in root.iter("Table"):
        name = _table_name(t.get("Name", ""))
        if wanted is not None and name != wanted:
            continue
        columns = [(_bare(c.get("Name", "")), c.get("Type", "lstring")) for c in t.findall("Column")]
        stream = t.find("Stream") if streams else None
        delimiter = (stream.get("Delimiter") if stream is not None else None) or ","
        text = (stream.text or "") if stream is not None else ""
        values = list(_values(text, delimiter))
        yield name, columns, [values[i : i + len(columns)] for i in range(0, len(values), len(columns))] if columns else []


#: Bytes of a file that a task parses whole, and characters of a line with markup that the driver takes.
WHOLE, LONGEST = 16 << 20, 1 << 20


def _raw(spark: SparkSession, paths: Sequence[str], wanted: str | None = None, streams: bool = True) -> DataFrame:
    """(name, columns, types, values): a row for each row of each table, or of those called ``wanted``; without streams, a row for each table. Files are read one a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                for name, columns, rows in _tables(content.as_py(), wanted, streams):
                    rows = rows or [None]
                    names, kinds = [c for c, _ in columns], [t for _, t in columns]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows)), pa.array([names] * len(rows), pa.list_(pa.string())), pa.array([kinds] * len(rows), pa.list_(pa.string())), pa.array(rows, pa.list_(pa.string()))], names=["name", "columns", "types", "values"])

    return spark.read.format("binaryFile").load(list(paths)).select("content").mapInArrow(run, "name string, columns array<string>, types array<string>, values array<string>")


@dataclass
class Stream:
    """A table's stream in a large file: from the first line to the last, each a block and a place in it, and its text on lines with markup."""

    name: str
    columns: list[tuple[str, str]]
    delimiter: str = ","
    first: tuple[Block, int] | None = None
    last: tuple[Block, int] | None = None
    texts: dict[int, str] = field(default_factory=dict)


def _skeleton(rows: Sequence[Any]) -> list[Stream] | None:
    """The tables of a file from its lines with markup; None if it has to be parsed whole."""
    text = "".join(f"{r.value}\n" for r in rows)
    coding = re.match(r"\ufeff?\s*<\?xml[^>]*encoding\s*=\s*[\"']([^\"']*)", text)
    if any(r.value is None or "\r" in r.value[:-1] or re.search(r"<!\[CDATA\[|<!ENTITY", r.value) or not re.fullmatch(r"(?:[^<]|<!--.*?-->|<(?!!--)[^<>]*>)*", r.value) for r in rows) or coding and coding[1].lower() not in ("utf-8", "utf8", "us-ascii", "ascii"):
        return None
    found: list[Stream] = []
    tables: list[Stream] = []
    path: list[str] = []
    parser = expat.ParserCreate("utf-8")

    def place() -> tuple[Block, int]:
        r = rows[parser.CurrentLineNumber - 1]
        return (r.file, r.start, r.length), r.at

    def start(tag: str, attributes: dict[str, str]) -> None:
        if tag == "Table":
            tables.append(Stream(_table_name(attributes.get("Name", "")), []))
            found.append(tables[-1])
        elif path[-1:] == ["Table"] and tag == "Column":
            tables[-1].columns.append((_bare(attributes.get("Name", "")), attributes.get("Type", "lstring")))
        elif path[-1:] == ["Table"] and tag == "Stream" and tables[-1].first is None:
            tables[-1].delimiter, tables[-1].first = attributes.get("Delimiter") or ",", place()
        path.append(tag)

    def end(tag: str) -> None:
        path.pop()
        if tag == "Table":
            tables.pop()
        elif path[-1:] == ["Table"] and tag == "Stream" and tables[-1].last is None:
            tables[-1].last = place()

    def data(text: str) -> None:
        if path[-2:] == ["Table", "Stream"] and tables[-1].last is None:
            at = place()[1]
            tables[-1].texts[at] = tables[-1].texts.get(at, "") + text

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler, parser.buffer_text = start, end, data, False
    try:
        parser.Parse(text.encode(), True)
    except expat.ExpatError:
        return None  # the whole file tells what is wrong
    return None if any(s.first and (len(s.delimiter) != 1 or s.delimiter.isspace() or s.delimiter in "\"\\&") for s in found) else found


def _files(spark: SparkSession, paths: Sequence[str]) -> tuple[list[str], DataFrame | None, list[Stream]]:
    """The files to parse whole; the lines of the others, and their tables."""
    files = spark.read.format("binaryFile").load(list(paths)).select("path", "length", F.xxhash64("_metadata.file_path").alias("file")).collect()  # a row for each file
    large = {r.file: r.path for r in files if r.length > WHOLE}
    whole, streams = [r.path for r in files if r.length <= WHOLE], []
    if not large:
        return whole, None, []
    lines = read_lines(spark, list(large.values())).withColumn("at", F.monotonically_increasing_id())
    marked = lines.where(F.contains("value", F.lit("<"))).withColumn("value", F.when(F.length("value") <= LONGEST, F.col("value")))
    by_file: dict[int, list] = {}
    for r in sorted(marked.collect(), key=lambda r: (r.file, r.start, r.at)):
        by_file.setdefault(r.file, []).append(r)
    for file, path in large.items():
        found = _skeleton(by_file[file]) if file in by_file else None
        whole += [path] if found is None else []
        streams += found or []
    return whole, lines, streams


def _unescaped(text: str) -> str:
    return re.sub(r"&(?:lt|gt|amp|quot|apos|#\d+|#x[\da-fA-F]+);", lambda m: html.unescape(m[0]) if m[0][1] != "#" else chr(int(m[0][3:-1], 16) if m[0][2] == "x" else int(m[0][2:-1])), text)


CLOSING, QUOTED = (re.compile(x, re.DOTALL) for x in (r'(?:[^"\\]|\\.)*"', r'"(?:[^"\\]|\\.)*"'))


def _cut(text: str, inside: bool, delimiter: str, n: int) -> int | None:
    """Where the ``n``-th delimiter outside quotes ends, in a text that starts in quotes or not."""
    at = 0
    if inside:
        if not (m := CLOSING.match(text)):
            return None
        at = m.end()
    for m in re.compile(rf'{QUOTED.pattern}|"|{re.escape(delimiter)}', re.DOTALL).finditer(text, at):
        if m[0] == '"':
            return None
        if m[0] == delimiter and not (n := n - 1):
            return m.end()
    return None


@dataclass
class _Count:
    """What is known of a piece of a stream that starts in quotes, or not: the delimiters outside quotes, and whether nothing comes after the last."""

    inside: bool
    n: int = 0
    blank: bool = True

    def add(self, text: str, delimiter: str) -> None:
        if self.inside:
            self.blank = False
            m = CLOSING.match(text) if '"' in text else None
            if not m:
                return
            text, self.inside = text[m.end() :], False
        if '"' in text:
            text, quote, _ = QUOTED.sub("\0", text).partition('"')
            self.inside = bool(quote)
        n = text.count(delimiter)
        self.n, self.blank = self.n + n, not self.inside and not text.rpartition(delimiter)[2].strip() and (n > 0 or self.blank)


#: Of a block: a stream's number, its first and last place if they lie in the block, and its text on lines with markup.
Part = tuple[int, int | None, int | None, dict[int, str]]


def _pieces(own: Iterator[list], parts: list[Part]) -> Iterator[tuple[int, str]]:
    """(stream, text) of a block's lines."""

    def read(at: int, line: str, texts: dict[int, str]) -> str:
        if "<" in line:
            return texts.get(at, "")
        line = line.removesuffix("\r").replace("\r", "\n")  # as a parser of XML has line ends
        return (_unescaped(line) if "&" in line else line) + "\n"

    for lines in own:
        for number, first, last, texts in parts:
            part = lines if first is None and last is None else [(at, x) for at, x in lines if (first is None or at >= first) and (last is None or at <= last)]
            text = "".join([f"{x}\n" for _, x in part])
            if any(x in text for x in "<&\r"):
                text = "".join([read(at, x, texts) for at, x in part])
            if text:
                yield number, text


def _read_streams(lines: DataFrame, streams: list[Stream], wanted: Sequence[str]) -> DataFrame:
    """The wanted columns of streams, as strings."""
    streams = [s for s in streams if s.first and s.columns]
    near = F.lit(False)
    for s in streams:
        (b0, a0), (b1, a1) = s.first, s.last
        at = lambda b: (F.col("start") == b[1])
        near = near | ((F.col("file") == b0[0]) & F.col("start").between(b0[1], b1[1]) & (~at(b0) | (F.col("at") >= a0)) & (~at(b1) | (F.col("at") <= a1)))
    lines = lines.where(near) if len(streams) <= 20 else lines

    def of(block: Block) -> list[Part]:
        return [(i, s.first[1] if s.first[0] == block else None, s.last[1] if s.last[0] == block else None, s.texts) for i, s in enumerate(streams) if s.first[0][0] == block[0] and s.first[0][1] <= block[1] <= s.last[0][1]]

    def rows(own: Iterator[list], state: dict, start: int) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[str, list, int]] = {}

        def made(number: int, final: bool) -> Iterator[pa.RecordBatch]:
            text, values, skip = held[number]
            d, names = streams[number].delimiter, [c for c, _ in streams[number].columns]
            if skip:
                if (end := _cut(text, state[number]["inside"], d, skip)) is None:
                    return
                text = text[end:]
            if '"' not in text:
                done, found, text = text.rpartition(d)
                values += [v.strip() or None for v in done.split(d)] if found else []
            else:
                end = 0
                for m in iter(re.compile(rf'\s*(?:"((?:[^"\\]|\\.)*)"|([^{re.escape(d)}"]*?))\s*{re.escape(d)}', re.DOTALL).scanner(text).match, None):
                    quoted, plain = m.groups()
                    values.append(plain or None if quoted is None else re.sub(r"\\(.)", r"\1", quoted, flags=re.DOTALL) if "\\" in quoted else quoted)
                    end = m.end()
                text = text[end:]
            n = len(names)
            if final:
                values += _values(text, d)
                values += [None] * (-len(values) % n)
            whole = len(values) // n * n
            if whole:
                yield pa.RecordBatch.from_arrays([pa.array(values[names.index(c) : whole : n] if c in names else [None] * (whole // n), pa.string()) for c in wanted], names=[f"c{i}" for i in range(len(wanted))])
            held[number] = text, values[whole:], 0

        for number, text in _pieces(own, state["parts"]):
            if (skip := state[number]["skip"]) is not None:
                before, values, skip = held.get(number, ("", [], skip))
                held[number] = before + text, values, skip
                yield from made(number, False)
        for number, (text, values, skip) in list(held.items()):
            held[number] = text + state[number]["suffix"], values, skip
            yield from made(number, True)

    return from_states(lines, _states(lines, streams, of), rows, ", ".join(f"c{i} string" for i in range(len(wanted))))


def _states(lines: DataFrame, streams: list[Stream], of: Callable[[Block], list[Part]]) -> dict[Block, dict]:
    """For each block its streams, and of each: whether it starts in quotes there, how many delimiters end a row of a block before (None: there is nothing else), and the text that ends its own last row in blocks behind."""

    def counts(own: Iterator[list], block: Block) -> dict[int, tuple[_Count, _Count]]:
        found: dict[int, tuple[_Count, _Count]] = {}
        for number, text in _pieces(own, of(block)):
            for count in found.setdefault(number, (_Count(False), _Count(True))):
                count.add(text, streams[number].delimiter)
        return found

    states: dict[Block, dict] = {}
    now: dict[int, tuple[bool, int, dict]] = {}
    ends: list[tuple[Block, int, dict]] = []
    wants: dict[Block, dict[int, tuple[bool, int]]] = {}
    for blocks in summaries(lines, counts).values():
        for block, found in blocks:
            state = states[block] = {"parts": of(block)}
            for number, by in found.items():
                inside, need, owner = now.get(number, (False, 0, {}))
                count, columns = by[inside], len(streams[number].columns)
                plan = state[number] = {"inside": inside, "skip": need, "suffix": ""}
                if need:
                    wants.setdefault(block, {})[number] = inside, need
                    ends.append((block, number, owner))
                if need and count.n < need:
                    plan["skip"], need = None, need - count.n
                else:
                    left = (count.n - need) % columns
                    owner, need = plan, columns - left if left or not count.blank else 0
                now[number] = count.inside, need, owner

    def heads(own: Iterator[list], block: Block) -> dict[int, str]:
        found: dict[int, str] = {}
        done: set[int] = set()
        for number, text in _pieces(own, of(block)):
            if number in wants[block] and number not in done:
                found[number] = found.get(number, "") + text
                if end := _cut(found[number], wants[block][number][0], streams[number].delimiter, wants[block][number][1]):
                    found[number] = found[number][:end]
                    done.add(number)
        return found

    if wants:  # the ends of rows that start in blocks before
        starts = sorted({b[1] for b in wants})
        near = lines.where(F.col("start").isin(starts)) if len(starts) <= 1000 else lines
        made = dict(x for found in summaries(near, lambda own, b: heads(own, b) if b in wants else {}).values() for x in found)
        for block, number, owner in ends:
            owner["suffix"] += made[block][number]
    return states


def list_tables(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    whole, _, streams = _files(spark, paths)
    return sorted({s.name for s in streams} | ({r.name for r in _raw(spark, whole, None, False).select("name").distinct().collect()} if whole else set()))


def read_table(spark: SparkSession, paths: Sequence[str], *, tablename: str | None = None, columns: Sequence[str] | None = None, rename: dict[str, str] | None = None) -> DataFrame:
    """A table of the documents, typed as declared; values of which nothing is written are null. The only table, unless one is named."""
    whole, lines, streams = _files(spark, paths)
    if tablename is None:
        names = sorted({s.name for s in streams} | ({r.name for r in _raw(spark, whole, None, False).select("name").distinct().collect()} if whole else set()))
        if len(names) != 1:
            raise ValueError(f"name one of the tables {names}")
        tablename = names[0]
    streams = [s for s in streams if s.name == tablename]
    rows = _raw(spark, whole, tablename) if whole else None
    head = _raw(spark, whole, tablename, False).select("columns", "types").first() if whole else None
    declared = list(zip(head.columns, head.types, strict=True)) if head else streams[0].columns if streams else None
    if declared is None:
        raise ValueError(f"no table {tablename!r}")
    at = {c: (i, TYPES.get(t, "string")) for i, (c, t) in enumerate(declared)}
    wanted = list(columns) if columns else list(at)
    name = lambda c: (rename or {}).get(c, c)
    value = lambda i: F.get("values", F.lit(i))
    parts = [rows.where("values is not null").select(*[value(at[c][0]).cast(at[c][1]).alias(name(c)) for c in wanted])] if head else []
    if streams:
        parts.append(_read_streams(lines, streams, wanted).select(*[F.col(f"c{i}").cast(at[c][1]).alias(name(c)) for i, c in enumerate(wanted)]))
    return parts[0] if len(parts) == 1 else parts[0].union(parts[1])


#: Spark's types of numbers, and the column types that they are declared as.
DECLARED = {"smallint": "int_2s", "int": "int_4s", "bigint": "int_8s", "float": "real_4", "double": "real_8"}


def _escaped(c: Column) -> Column:
    """Markup, and the line ends that a parser of XML would change, as references."""
    for mark, reference in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\r", "&#13;")):
        c = F.replace(c, F.lit(mark), F.lit(reference))
    return c


def document_lines(tables: dict[str, DataFrame]) -> DataFrame:
    """(part, line, value): the lines of a document in order of part and line. Strings keep every character that XML has."""

    def written(name: str, kind: str) -> Column:
        c = F.col(f"`{name}`")
        if kind in DECLARED:
            return c.cast("string")
        quoted = F.regexp_replace(c.cast("string"), r'(["\\])', r"\\$1")
        return F.concat(F.lit('"'), _escaped(quoted), F.lit('"'))

    spark, parts, fixed = next(iter(tables.values())).sparkSession, [], [(0, 0, '<?xml version="1.0"?>'), (0, 1, "<LIGO_LW>")]
    for i, (name, df) in enumerate(tables.items()):
        head = [f'<Table Name="{name}:table">', *[f'<Column Name="{c}" Type="{DECLARED.get(t, "lstring")}"/>' for c, t in df.dtypes], f'<Stream Name="{name}:table" Type="Local" Delimiter=",">']
        fixed += [(3 * i + 1, n, x) for n, x in enumerate(head)] + [(3 * i + 3, 0, "</Stream></Table>")]
        values = F.concat(*[x for c, t in df.dtypes for x in (F.coalesce(written(c, t), F.lit("")), F.lit(","))])
        parts.append(df.select(F.lit(3 * i + 2).alias("part"), F.monotonically_increasing_id().alias("line"), values.alias("value")))
    fixed.append((3 * len(tables) + 1, 0, "</LIGO_LW>"))
    out = spark.createDataFrame(fixed, "part int, line long, value string")
    for p in parts:
        out = out.unionByName(p)
    return out


def write_document(tables: dict[str, DataFrame], path: str, mode: str = "errorifexists") -> None:
    """A document is one file, which one task writes; nothing comes to the driver."""
    write_numbered(document_lines(tables), path, mode)


def write_table(df: DataFrame, path: str, *, tablename: str, mode: str = "errorifexists") -> None:
    write_document({tablename: df}, path, mode)


#: Format names that start with `ligolw` are those that files of this XML dialect are known by.
register("ligolw", read=read_table, write=write_table, extensions=("xml",))


def read_array(spark: SparkSession, paths: Sequence[str], *, name: str | None = None, epoch: float | None = None, **params: str) -> DataFrame:
    """(name, idx, x, value) of <Array> elements: matched by name, by the epoch of their element and by its other <Param> values.

    A stream of one column has its axis from the start and scale of the first
    <Dim>; of two, the first column is the axis.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                root = ElementTree.parse(io.BytesIO(content.as_py())).getroot()
                for parent in root.iter("LIGO_LW"):
                    have = {p.get("Name", "").removesuffix(":param"): (p.text or "").strip() for p in parent.findall("Param")}
                    time = next((float(t.text or 0) for t in parent.findall("Time")), None)
                    if (epoch is not None and time != epoch) or any(have.get(k) != str(v) for k, v in params.items()):
                        continue
                    for a in parent.findall("Array"):
                        label = a.get("Name", "").removesuffix(":array")
                        if name is not None and name not in (label, _bare(label)):
                            continue
                        dims = a.findall("Dim")
                        stream = a.find("Stream")
                        v = [float(s) for s in (stream.text or "").replace(stream.get("Delimiter", " "), " ").split()]
                        n = int((dims[0].text or "0").strip()) if dims else len(v)
                        if n and len(v) >= 2 * n:
                            step = len(v) // n
                            x, y = v[::step], v[1::step]
                        else:
                            x0, dx = (float(dims[0].get(k, d)) for k, d in (("Start", "0"), ("Scale", "1"))) if dims else (0.0, 1.0)
                            x, y = [x0 + i * dx for i in range(len(v))], v
                        yield pa.RecordBatch.from_arrays([pa.array([label] * len(y)), pa.array(range(len(y)), pa.int64()), pa.array(x, pa.float64()), pa.array(y, pa.float64())], names=["name", "idx", "x", "value"])

    return spark.read.format("binaryFile").load(list(paths)).select("content").mapInArrow(run, "name string, idx long, x double, value double")


register("ligolw.array", read=read_array)
