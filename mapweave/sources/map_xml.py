"""Map XML (plain, gzip or bzip2) as node, way and relation tables.

Files are read as text cut before each element, which Spark splits over tasks at any place, and each element is
decoded: by regular expressions if it is written as plainly as map tools do (no entities, comments or other children),
else by Spark's XML parser, which takes many times longer.  Plain and bzip2 files are split, also within elements of many lines; a gzip file is
one task by nature of the format, so large extracts are better given as many files, as plain XML, or converted to
parquet once.  Text that looks like an element inside comments or CDATA sections is not told apart.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import record

_TAG = "tag array<struct<_k:string,_v:string>>"
_SCHEMAS = {
    "node": f"_id long, _lat double, _lon double, {_TAG}",
    "way": f"_id long, nd array<struct<_ref:long>>, {_TAG}",
    "relation": f"_id long, member array<struct<_type:string,_ref:long,_role:string>>, {_TAG}",
}
# Attributes, then the end of an empty element or everything up to the closing tag.
_ELEMENT = r"(?s)^(?:\s+[^\s=<>/]+\s*=\s*(?:\"[^\"]*\"|'[^']*'))*\s*(?:/>|>.*?</{}\s*>)"
# What is read without the parser: whole numbers of 18 digits at most, values without entities and control characters,
# children with these attributes in this order, and no attribute twice.
_WHOLE, _NUMBER = r"-?(?:0|[1-9][0-9]{0,17})", r"-?[0-9]{1,3}(?:\.[0-9]{1,18})?"
_CONTROL = "".join(f"\\x{c:02X}" for c in range(32))  # one by one: Java looks single characters up in one table
_VALUE = f'[^"&<>{_CONTROL}]*+'
_CHILDREN = {
    "nd": rf'<nd ref="({_WHOLE})"\s*/>',
    "tag": rf'<tag k="({_VALUE})" v="({_VALUE})"\s*/>',
    "member": rf'<member type="({_VALUE})" ref="({_WHOLE})" role="({_VALUE})"\s*/>',
}
_NUMBERS = {"node": {"id": _WHOLE, "lat": _NUMBER, "lon": _NUMBER}, "way": {"id": _WHOLE}, "relation": {"id": _WHOLE}}
_PARTS = {"node": ["tag"], "way": ["nd", "tag"], "relation": ["member", "tag"]}
_TYPES = {"nd": "array<struct<_ref:long>>", "tag": "array<struct<_k:string,_v:string>>", "member": "array<struct<_type:string,_ref:long,_role:string>>"}
MEMBER_TYPES = ["node", "way", "relation"]


@dataclass(frozen=True)
class RawMap:
    """Elements as read, repeated ids included; ``pos`` orders them as in the files."""

    nodes: DataFrame
    ways: DataFrame
    relations: DataFrame


def read_map_xml(spark: SparkSession, path: str) -> RawMap:
    """Read every element of the files at ``path`` (a file, folder or glob)."""

    def elements(kind: str) -> DataFrame:
        tags = spark.read.option("lineSep", "<").text(path).select(
            F.concat(F.lit("<"), "value").alias("text"),
            F.when(F.startswith("value", F.lit(kind)), F.col("_metadata.file_path")).alias("file"),
            F.col("_metadata.file_block_start").alias("start"), F.xxhash64("_metadata.file_path").alias("key"),
            (F.col("_metadata.file_block_length") < F.col("_metadata.file_size")).alias("cut"),
        )
        whole = tags.drop("cut").mapInArrow(_join_tags(kind, False), _PIECE)
        whole = whole.unionByName(_mended(tags.where("cut").drop("cut").mapInArrow(_join_tags(kind, True), _PIECE)))
        text = whole.select(
            "text", record(file=F.col("file"), start=F.col("start"), row=F.col("row")).alias("pos"), _is_plain(kind, F.col("text")).alias("plain"),
        )
        rest = F.when(~F.col("plain"), F.regexp_extract(F.substr("text", F.lit(len(kind) + 2)), _ELEMENT.format(kind), 0))
        found = text.select("*", rest.alias("rest")).where("plain or rest <> ''")
        decoded = F.from_xml(F.concat(F.lit(f"<{kind}"), F.col("rest")), _SCHEMAS[kind], {"rowTag": kind, "nullValue": "\u0000"})
        either = found.select("*", F.when(~F.col("plain"), decoded).alias("e")).where("plain or e._id is not null")
        return either.select(*[F.when(F.col("plain"), v).otherwise(F.col("e")[n]).alias(n) for n, v in _plain_fields(kind, F.col("text")).items()], "pos")

    nodes = elements("node").select(
        F.col("_id").alias("node_id"), F.col("_lat").alias("lat"), F.col("_lon").alias("lon"),
        tag_map(F.col("tag")).alias("tags"), "pos",
    )
    ways = elements("way").select(
        F.col("_id").alias("way_id"),
        F.coalesce(F.col("nd._ref"), F.array().cast("array<long>")).alias("node_refs"),
        tag_map(F.col("tag")).alias("tags"), "pos",
    )
    relations = elements("relation").select(
        F.col("_id").alias("rel_id"),
        known_members(F.col("member")).alias("members"),
        tag_map(F.col("tag")).alias("tags"), "pos",
    )
    return RawMap(nodes, ways, relations)


def _is_plain(kind: str, text: Column) -> Column:
    """Whether an element can be read without the parser."""
    wanted = "".join(rf'(?=[^>]*\s{name}="{value}")' for name, value in _NUMBERS[kind].items())
    attributes = rf'(?:\s+(\w+)="[^"&<>={_CONTROL}]*+"(?![^>]*\s\1=))*'
    start = rf"^<{kind}{wanted}{attributes}\s*"
    # Children that a tag follows are taken out; nothing but the two tags may be left.
    left = F.regexp_replace(text, rf"(?:{'|'.join(_CHILDREN[c] for c in _PARTS[kind])})\s*+(?=<)", "")
    return left.rlike(rf"{start}>\s*</{kind}\s*>[^<>]*$") | text.rlike(rf"{start}/>[^<>]*$")


def _plain_fields(kind: str, text: Column) -> dict[str, Column]:
    """The fields of the kind's schema; values lose outer blanks, as the parser trims them."""
    out = {
        f"_{name}": F.regexp_extract(text, rf'\s{name}="({value})"', 1).cast("long" if value == _WHOLE else "double")
        for name, value in _NUMBERS[kind].items()
    }
    for child in _PARTS[kind]:
        groups = range(1, _CHILDREN[child].count("(") - _CHILDREN[child].count("(?") + 1)
        values = [F.transform(F.regexp_extract_all(text, F.lit(_CHILDREN[child]), F.lit(g)), lambda v: F.trim(v)) for g in groups]
        out[child] = F.arrays_zip(*values).cast(_TYPES[child])
    return out


_PIECE = "text string, file string, start long, key long, row long, head boolean"
_NAMES = ["text", "file", "start", "key", "row", "head"]
_ARROW = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
_LAST = 1 << 62  # row of an element that goes on behind its split: the last one of the split


def _join_tags(kind: str, edges: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Join the tags of each element of a kind that lies in one split (a task may read several, one after the other).

    With ``edges`` what splits cut instead: the open element at a split's end (``head``), and a split's tags before its
    first element, if they go on to the end of the element or fill the split.

    Columns: text, file (where a row begins an element of the kind), start, key (of the file)."""
    mine_, own_end_ = rf"^<{kind}[\s/>]", rf"^</{kind}[\s>]"
    start_, end_ = r"^<(?:node|way|relation)[\s/>]", r"^</(?:node|way|relation)[\s>]"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, seen, ended = None, 0, False
        parts, role, row, done, name = [], "", 0, False, None  # the piece at work: an own element, a lead of a split, or nothing of use

        def close(out: list, at_end: bool) -> None:
            """Put out the piece at work, which the end of a split or the next piece has ended."""
            is_head = role == "own" and at_end and not done
            of_use = role == "own" or role == "lead" and (done or at_end)
            if parts and of_use and edges == (is_head or role == "lead"):
                out.append(("".join(parts), name, *split, row, is_head))

        for batch in _near_edges(batches, start_) if edges else batches:
            n, out = batch.num_rows, []
            if n == 0:
                continue
            text, file = batch.column(0), batch.column(1)
            start, key = (batch.column(c).to_numpy(zero_copy_only=False) for c in (2, 3))
            mark = lambda pattern: pc.match_substring_regex(text, pattern).to_numpy(zero_copy_only=False)
            begin, mine, end, own_end = mark(start_), mark(mine_), mark(end_), mark(own_end_)
            over = end | mine & mark(r"/>\s*$")
            fresh = np.r_[split != (int(start[0]), int(key[0])), (key[1:] != key[:-1]) | (start[1:] != start[:-1])]
            # A piece begins at each start, at each split and after each end; the first may go on from the batch before.
            cut = begin | fresh | np.r_[ended, over[:-1]]
            at = np.union1d([0], np.flatnonzero(cut))
            edge = np.r_[at, n]
            texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(edge, pa.int32()), text), "")
            closed_by_split = np.r_[fresh[at[1:]], False]
            inner = cut[at] & ~fresh[at] & ~closed_by_split
            inner[-1] = False
            if cut[0]:
                close(out, bool(fresh[0]))
                parts, role = [], ""
            for k in np.flatnonzero(~inner).tolist():
                i, j = int(edge[k]), int(edge[k + 1])
                if cut[i]:
                    if fresh[i]:
                        split = (int(start[i]), int(key[i]))
                    lead = fresh[i] and start[i] > 0 and not begin[i]
                    parts, role, row, done = [], "own" if mine[i] else "lead" if lead else "", seen + i, False
                    name = file[i].as_py()
                if role:
                    parts.append(texts[k].as_py())
                    done = bool(own_end[j - 1] or over[j - 1] and role == "own")
                    if role == "lead" and end[j - 1] and not done:
                        role = ""  # the end of another kind of element
                if k < len(at) - 1:
                    close(out, bool(closed_by_split[k]))
                    parts, role = [], ""
            columns = [pa.array([r[c] for r in out], t) for c, t in enumerate(_ARROW)]
            if not edges:
                pick = np.flatnonzero(inner & mine[at])
                more = [texts.take(pa.array(pick)), file.take(pa.array(at[pick])), pa.array(start[at[pick]]), pa.array(key[at[pick]]), pa.array(seen + at[pick]), pa.array(np.zeros(len(pick), bool))]
                columns = [pa.concat_arrays([c, m]) for c, m in zip(columns, more)]
            seen, ended = seen + n, bool(over[-1])
            yield pa.RecordBatch.from_arrays(columns, _NAMES)
        out = []
        close(out, True)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(out[0], _ARROW)], _NAMES)

    return run


def _near_edges(batches: Iterator[pa.RecordBatch], start_: str) -> Iterator[pa.RecordBatch]:
    """Leave out what lies between the first element of a split and its last: batches inside a split, before one that begins
    an element."""
    split, begun, held = None, False, []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        start, key = (batch.column(c).to_numpy(zero_copy_only=False) for c in (2, 3))
        begins = bool(pc.any(pc.match_substring_regex(batch.column(0), start_)).as_py())
        inside = split == (start[0], key[0]) and bool(((start == start[0]) & (key == key[0])).all())
        split = (start[-1], key[-1])
        if inside and begun:
            held = [batch] if begins else [*held, batch]
            continue
        yield from held
        # In a batch where a split begins it is not known which split an element is of: the next batch is looked at, too.
        held, begun = [], inside and begins
        yield batch
    yield from held


def _mended(pieces: DataFrame) -> DataFrame:
    """Elements that splits cut: each head with the leads after it.  A split brings two short pieces at most."""
    order = Window.partitionBy("key").orderBy("start", "row")
    begun = F.last(F.when(F.col("head"), F.struct("start", "row")), ignorenulls=True).over(order)
    whole = pieces.select("*", begun.alias("at")).where("at is not null").groupBy("key", "at").agg(
        F.sort_array(F.collect_list(F.struct("start", "row", "text"))).alias("pieces"), F.max(F.when(F.col("head"), F.col("file"))).alias("file")
    )
    return whole.select(F.array_join("pieces.text", "").alias("text"), "file", "at.start", "key", F.lit(_LAST).alias("row"), F.lit(True).alias("head"))


def tag_map(tags: Column) -> Column:
    """List of (key, value) -> map; the last value of a repeated key wins."""
    empty = F.array().cast("array<struct<_k:string,_v:string>>")
    listed = F.coalesce(tags, empty)
    last = F.filter(
        listed,
        lambda t, i: ~F.exists(F.slice(listed, i + 2, F.size(listed)), lambda later: later["_k"] == t["_k"]),
    )
    return F.map_from_entries(last)


def known_members(members: Column) -> Column:
    """Members in order as struct<type,ref,role>; other member types are left out."""
    empty = F.array().cast("array<struct<_type:string,_ref:long,_role:string>>")
    return F.transform(
        F.filter(F.coalesce(members, empty), lambda m: m["_type"].isin(MEMBER_TYPES)),
        lambda m: record(
            type=m["_type"], ref=m["_ref"], role=F.coalesce(m["_role"], F.lit(""))
        ),
    )


def last_per_id(raw: DataFrame, key: str) -> DataFrame:
    """One row per id: the last read.

    ``max_by`` is combined before the shuffle, so an id repeated any number of
    times sends one row per task."""
    values = [c for c in raw.columns if c not in (key, "pos")]
    newest = raw.groupBy(key).agg(F.max_by(F.struct(*values), F.col("pos")).alias("newest"))
    return newest.select(key, *[F.col("newest")[c].alias(c) for c in values])


def way_refs(ways: DataFrame) -> DataFrame:
    """One row per reference of a way, in order."""
    return ways.select("way_id", F.posexplode("node_refs").alias("seq", "node_id"))


def relation_members(relations: DataFrame) -> DataFrame:
    """One row per member of a relation, in order."""
    return relations.select("rel_id", F.posexplode("members").alias("seq", "member")).select(
        "rel_id", "seq", F.col("member.type").alias("type"), F.col("member.ref").alias("ref"),
        F.col("member.role").alias("role"),
    )
