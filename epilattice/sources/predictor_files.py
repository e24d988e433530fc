"""Predictors' files and score tables as Python data sources: `spark.read.format(...)` and `CREATE VIEW ... USING ...`.

    register_sources(spark)
    spark.read.format("wide_mhci").option("path", folder).load().where("allele = 'H-2-Kb'")

Formats: `fasta`, `wide_mhci`, `wide_mhcii`, `allele_scores`, with the columns of the readers of these names. Option
`path` is a file, or a folder searched at any depth, by any URI that pyarrow opens (local, hdfs, s3, gs); other stores
go through `readers`. Names that begin with `_` or `.` are left out; `pathGlobFilter` keeps the names that match.

Files are cut into partitions of `splitBytes` (64 MB unless set); compressed ones are a partition each. A partition
reads the lines, or records, that begin in it, and the head of its file. Equality and IN on `allele` are pushed into
the source: the cells of other alleles are never parsed, nor are files opened beyond their heads if they name none that
is asked for.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from fnmatch import fnmatch
from itertools import islice

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.labels import NUMBER

SPLIT, CHUNK, ROWS = 64 << 20, 1 << 20, 8192
COMPRESSED = (".gz", ".bz2", ".zst", ".lz4")
_number = re.compile(NUMBER)


@dataclass
class Part(InputPartition):
    """The pieces of a file that begin from `start` to before `end`."""

    path: str
    start: int
    end: int


def number(cell: str) -> float | None:
    """A cell as the readers take it: a number, or null."""
    cell = cell.strip(" ")
    return float(cell) if _number.match(cell) else None


def pieces(file, start: int, end: int, sep: bytes) -> Iterator[bytes]:
    """The stretches between separators that begin in [start, end). A piece begins at 0 and after every separator."""
    at = max(start - 1, 0)
    if at:
        file.seek(at)
    begun, held = start == 0, []
    while chunk := file.read(CHUNK):
        *ended, rest = chunk.split(sep)
        for piece in ended:
            if begun:
                held.append(piece)
                yield b"".join(held)
                held.clear()
            begun, at = True, at + len(piece) + len(sep)
            if at >= end:
                return
        at += len(rest)
        if begun:
            held.append(rest)
    if begun:
        yield b"".join(held)


class FilesReader(DataSourceReader):
    """Cuts files into parts and yields their rows in Arrow batches; kinds of files say what their rows are."""

    separator = b"\n"

    def __init__(self, schema: StructType, options):
        if not options.get("path"):
            raise ValueError("option path is missing")
        self.schema, self.uri, self.glob = schema, options["path"], options.get("pathGlobFilter")
        self.split = int(options.get("splitBytes", SPLIT))
        self.alleles: frozenset | None = None  # those that are asked for; all if None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        named = "allele" in self.schema.names
        for f in filters:
            if named and isinstance(f, EqualTo | In) and f.attribute == ("allele",):
                asked = frozenset(f.value if isinstance(f, In) else [f.value])
                self.alleles = asked if self.alleles is None else self.alleles & asked
            elif not (named and isinstance(f, IsNotNull) and f.attribute == ("allele",)):
                yield f

    def asked(self, allele: str) -> bool:
        return self.alleles is None or allele in self.alleles

    def taken(self, path: str, base: str) -> bool:
        inner = path[len(base) :].strip("/").split("/")
        return not any(p.startswith(("_", ".")) for p in inner) and (not self.glob or fnmatch(path.rsplit("/", 1)[-1], self.glob))

    def partitions(self) -> list[Part]:
        store, base = fs.FileSystem.from_uri(self.uri)
        found = store.get_file_info(base)
        if found.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.uri)
        files = [found] if found.is_file else [f for f in store.get_file_info(fs.FileSelector(base, recursive=True)) if f.is_file and self.taken(f.path, base)]
        if not files:
            raise ValueError(f"no files in {self.uri}")
        parts = []
        for f in sorted(files, key=lambda f: f.path):
            step = max(f.size, 1) if f.path.endswith(COMPRESSED) else self.split
            parts += [Part(f.path, at, at + step) for at in range(0, f.size, step)]
        # a compressed file's end is not known before it is read
        return [Part(p.path, 0, 1 << 62) if p.path.endswith(COMPRESSED) else p for p in parts]

    def opened(self, path: str):
        store, _ = fs.FileSystem.from_uri(self.uri)
        return store.open_input_stream(path) if path.endswith(COMPRESSED) else store.open_input_file(path)

    def lines(self, part: Part) -> Iterator[str]:
        with self.opened(part.path) as file:
            for piece in pieces(file, part.start, part.end, self.separator):
                yield piece.decode("utf-8", "replace").rstrip("\r")

    def head(self, path: str) -> Iterator[str]:
        """A file's first lines, read no further than they are looked at."""
        return self.lines(Part(path, 0, 1 << 62))

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        schema, rows = to_arrow_schema(self.schema), self.rows(partition)
        while some := list(islice(rows, ROWS)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), schema, strict=True)], schema=schema)

    def rows(self, part: Part) -> Iterator[tuple]:
        raise NotImplementedError


class FastaReader(FilesReader):
    separator = b">"

    def rows(self, part):
        for record in self.lines(part):
            header, _, body = record.replace("\r", "").partition("\n")
            header, sequence = header.strip(" "), re.sub(r"\s+", "", body, flags=re.ASCII)
            name = re.split(r"\s+", header, maxsplit=1, flags=re.ASCII)[0]
            if name and sequence:
                yield name, header, sequence


class WideReader(FilesReader):
    """Files with a block of cells for each allele, under a header and a line of allele names."""

    header = "Pos\tPeptide\tID\t"

    def named(self, cell: str) -> bool:
        return cell != ""

    def heading(self, path: str) -> tuple[int, str, list[str]]:
        """How many lines come before the data, the header and the alleles."""
        before = ""
        for i, line in enumerate(self.head(path)):
            if line.startswith(self.header):
                if alleles := [c for c in (cell.strip(" ") for cell in before.split("\t")) if self.named(c)]:
                    return i + 1, line, alleles
                break
            if not re.match(r"\s*[0-9]+\t", line):
                before = line
        raise ValueError(f"no header or no allele names in {path}")

    def rows(self, part):
        skip, header, alleles = self.heading(part.path)
        wanted = [(i, a) for i, a in enumerate(alleles) if self.asked(a)]
        if not wanted:
            return
        # where a part begins within the head, only lines beyond it are data
        lines = islice(self.lines(part), skip, None) if part.start == 0 else self._beyond(part, skip)
        for line in lines:
            if line.strip(" ") and not line.startswith("#"):
                yield from self.blocks(line.split("\t"), header, wanted, len(alleles))

    def _beyond(self, part: Part, skip: int) -> Iterator[str]:
        with self.opened(part.path) as file:
            size = sum(len(x) + 1 for x in islice(pieces(file, 0, 1 << 62, self.separator), skip))
        return self.lines(Part(part.path, max(part.start, size), part.end)) if size < part.end else iter(())

    def blocks(self, cells: list[str], header: str, wanted: list[tuple[int, str]], n: int) -> Iterator[tuple]:
        raise NotImplementedError


class WideOneReader(WideReader):
    def named(self, cell):
        return "-" in cell or cell.startswith("HLA")

    def blocks(self, cells, header, wanted, n):
        width = 6 if "\tBA_score" in header else 4
        for i, allele in wanted:
            own = cells[3 + i * width : 3 + (i + 1) * width]
            if len(own) == width:  # a row ends at its first incomplete block
                scores = [number(c) for c in own[2:]]
                yield (cells[1], len(cells[1]), allele, *scores, *[None] * (6 - width))


class WideTwoReader(WideReader):
    header = "Pos\tPeptide\tID\tTarget\t"

    def blocks(self, cells, header, wanted, n):
        if len(cells) >= 4 + 4 * n:
            for i, allele in wanted:
                core, *scores = cells[4 + 4 * i : 8 + 4 * i]
                yield (cells[1], allele, core, *map(number, scores))


class ScoresReader(FilesReader):
    """Tab-separated score tables, columns by name; cells are text and missing ones null. Folders that end in
    _combined are left out."""

    def taken(self, path, base):
        return super().taken(path, base) and not re.search(r"_combined/[^/]*$", path)

    def rows(self, part):
        cells = lambda line: next(csv.reader([line], delimiter="\t"))
        names = {name: i for i, name in enumerate(cells(next(self.head(part.path), "")))}
        if lacking := [c for c in ("allele", "variant_id", "VR_mutation") if c not in names]:
            raise ValueError(f"{part.path}: no columns {lacking}")
        places = [names.get(c) for c in self.schema.names[:-1]]
        for line in islice(self.lines(part), 1 if part.start == 0 else 0, None):
            if line:
                own = cells(line)
                if self.alleles is None or own[names["allele"]] in self.alleles:
                    yield (*[own[p] or None if p is not None and p < len(own) else None for p in places], part.path)


class Fasta(DataSource):
    kind, columns = FastaReader, "variant_id string, record_desc string, aa_sequence string"

    @classmethod
    def name(cls):
        return "fasta"

    def schema(self):
        return self.columns

    def reader(self, schema):
        return self.kind(schema, self.options)


class WideOne(Fasta):
    kind = WideOneReader
    columns = "peptide string, k int, allele string, netMHCpan_EL_score double, netMHCpan_EL_rank double, netMHCpan_BA_score double, netMHCpan_BA_rank double"

    @classmethod
    def name(cls):
        return "wide_mhci"


class WideTwo(Fasta):
    kind = WideTwoReader
    columns = "peptide string, allele string, netMHCIIpan_core string, netMHCIIpan_inverted double, netMHCIIpan_EL_score double, netMHCIIpan_EL_rank double"

    @classmethod
    def name(cls):
        return "wide_mhcii"


class Scores(Fasta):
    """Option `outcomes` names the score columns, comma between; `readers.tidy_scores` checks and reads the rows."""

    kind = ScoresReader

    @classmethod
    def name(cls):
        return "allele_scores"

    def schema(self):
        outcomes = [o.strip() for o in self.options.get("outcomes", "").split(",") if o.strip()]
        return "allele string, variant_id string, VR_mutation string, " + "".join(f"`{o}` string, " for o in outcomes) + "_file string"


def register_sources(spark: SparkSession) -> None:
    """Makes the formats known to the session, and lets Spark push filters into them."""
    for source in (Fasta, WideOne, WideTwo, Scores):
        spark.dataSource.register(source)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", True)
