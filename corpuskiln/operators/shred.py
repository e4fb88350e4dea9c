"""Shredding nested records (XML or JSON text) into an adjacency table and from there into flat tables.

Each record becomes nodes (node, parent, label, ordinal, scalar), numbered level by level, so that the
children of a node stand next to each other.  A record keeps its nodes together in one row: the joins of
the adjacency table with itself (an object node with its scalar children, which are pivoted into columns,
and with the nodes above it) then go by number within the row, are done by the JVM and move nothing, and
each text is taken apart once.  ``adjacency`` gives the same nodes as a table of rows.
"""

from __future__ import annotations

import json
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NODE = "parent int, label string, ordinal int, is_object boolean, scalar string, child_from int, n_children int"
RECORDS = f"sentence_id long, body_key long, nodes array<struct<{NODE.replace(' ', ':').replace(',:', ',')}>>"
_KINDS = (("parent", pa.int32()), ("label", pa.string()), ("ordinal", pa.int32()), ("is_object", pa.bool_()), ("scalar", pa.string()), ("child_from", pa.int32()), ("n_children", pa.int32()))
SECTIONS = {"MorphemeAnnotations": "M", "LearnerErrorAnnotations": "E"}
#: Elements that stay objects even where the record holds only a text in their place.
ENTITIES = frozenset({"SENTENCE", "word", "morph", *SECTIONS})
#: Nodes that one Arrow batch holds before it is sent.
BATCH = 100_000


class _Nodes:
    """Columns of nodes, filled level by level."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.parent, self.label, self.ordinal, self.is_object, self.scalar, self.child_from, self.n_children = self.columns = tuple([] for _ in _KINDS)

    def __len__(self) -> int:
        return len(self.label)

    def cut(self, n: int) -> None:
        for column in self.columns:
            del column[n:]

    def add(self, parent: int | None, label: str, ordinal: int, is_object: bool, scalar: str | None) -> None:
        self.parent.append(parent)
        self.label.append(label)
        self.ordinal.append(ordinal)
        self.is_object.append(is_object)
        self.scalar.append(scalar)
        self.child_from.append(0)
        self.n_children.append(0)

    def xml(self, body: str) -> None:
        root = ET.fromstring(body)
        if root.tag != "SENTENCE":
            root = next(root.iter("SENTENCE"), root)
        base, add = len(self), self.add
        add(None, root.tag, 1, True, None)
        queue = [(0, root)]
        for node, element in queue:
            first = len(self.label)
            for name, value in element.attrib.items():
                add(node, "@" + name, 1, False, value)
            text = element.text
            if len(element):
                text = "".join([text or "", *(c.tail or "" for c in element)])
            if text and (len(element) == 0 or text.strip()):
                add(node, "#text", 1, False, text)
            seen: dict[str, int] = {}
            for child in element:
                tag = child.tag
                if isinstance(tag, str):
                    ordinal = seen[tag] = seen.get(tag, 0) + 1
                    if child.attrib or len(child) or tag in ENTITIES:
                        queue.append((len(self.label) - base, child))
                        add(node, tag, ordinal, True, None)
                    else:
                        add(node, tag, ordinal, False, child.text)
            self.child_from[base + node] = first - base
            self.n_children[base + node] = len(self.label) - first

    def json(self, body: str) -> None:
        record = json.loads(body)
        if isinstance(record, dict) and "SENTENCE" in record:
            record = record["SENTENCE"]
        base, add = len(self), self.add
        queue: list[tuple[int, dict]] = []

        def put(parent: int | None, label: str, ordinal: int, value: object, item: bool) -> None:
            if isinstance(value, dict):
                queue.append((len(self.label) - base, value))
                add(parent, label, ordinal, True, None)
            elif label in ENTITIES and (item or value is not None):
                queue.append((len(self.label) - base, {} if value is None else {"#text": value}))
                add(parent, label, ordinal, True, None)
            else:
                add(parent, label, ordinal, False, value if value is None or isinstance(value, str) else json.dumps(value, ensure_ascii=False))

        for i, one in enumerate(record if isinstance(record, list) else [record]):
            put(None, "SENTENCE", i + 1, one, True)
        for node, element in queue:
            first = len(self.label)
            for name, value in element.items():
                if isinstance(value, list):  # an array stands for repeated elements of one name
                    for i, one in enumerate(value):
                        put(node, name, i + 1, one, True)
                else:
                    put(node, name, 1, value, False)
            self.child_from[base + node] = first - base
            self.n_children[base + node] = len(self.label) - first

    def array(self) -> pa.StructArray:
        return pa.StructArray.from_arrays([pa.array(c, k) for c, (_, k) in zip(self.columns, _KINDS)], [n for n, _ in _KINDS])


def _shred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    nodes = _Nodes()
    for batch in batches:
        ids, keys, offsets = [], [], [0]

        def flush() -> pa.RecordBatch:
            out = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), nodes.array())  # noqa: B023
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), out], names=["sentence_id", "body_key", "nodes"])  # noqa: B023

        for sid, key, body in zip(*(batch.column(c).to_pylist() for c in ("sentence_id", "body_key", "body"))):
            if body is None:
                continue
            try:
                if body.lstrip()[:1] == "<":
                    nodes.xml(body.strip())
                else:
                    nodes.json(body)
            except (ValueError, ET.ParseError, RecursionError) as error:
                nodes.cut(offsets[-1])
                nodes.add(None, "#error", 1, False, str(error)[:200])
            ids.append(sid)
            keys.append(key)
            offsets.append(len(nodes))
            if len(nodes) > BATCH:
                yield flush()
                nodes.clear()
                ids, keys, offsets = [], [], [0]
        if ids:
            yield flush()
            nodes.clear()


def shred(records: DataFrame, repeated: bool = False) -> DataFrame:
    """The nodes of each record of ``sentence_id``, ``body``, one row for each record.

    A record delivered twice with the same body counts once, unless ``repeated`` asks for all rows.  A
    null body has no row; a body that is neither XML nor JSON has one node ``#error`` whose scalar says
    why.  Attributes are labelled ``@name``, the text of an element ``#text``; ``ordinal`` counts
    siblings of one label from 1; ``parent`` is the place of the parent node, from 0, and the children
    are ``n_children`` nodes from ``child_from`` on.  In JSON a null in place of an element means that
    there is none; a null within an array is an element without content.
    """
    bodies = records.select("sentence_id", "body", F.xxhash64("body").alias("body_key"))
    return (bodies if repeated else bodies.dropDuplicates(["sentence_id", "body"])).mapInArrow(_shred, RECORDS)


def adjacency(shredded: DataFrame) -> DataFrame:
    """The adjacency table: one row for each node of each record."""
    return shredded.select("sentence_id", "body_key", F.posexplode("nodes").alias("node", "n")).select("sentence_id", "body_key", "node", "n.*")


def _entities(shredded: DataFrame, label: str, made) -> DataFrame:
    """One row of ``made(node)`` for each object node of a label."""
    chosen = F.filter("nodes", lambda n: (n["label"] == label) & n["is_object"])
    return shredded.select("sentence_id", "body_key", F.explode(F.transform(chosen, made)).alias("e")).select("sentence_id", "body_key", "e.*")


def _above(node: Column) -> Column:
    return F.get(F.col("nodes"), node["parent"])


def _child(node: Column, label: str) -> Column:
    """The first child of a label."""
    below = F.slice(F.col("nodes"), node["child_from"] + 1, node["n_children"])
    return F.get(F.filter(below, lambda c: (c["label"] == label) & (c["ordinal"] == 1)), F.lit(0))


def _scalar(node: Column, label: str) -> Column:
    return _child(node, label)["scalar"]


def _section(node: Column) -> Column:
    label = node["label"]
    return F.when(label == "MorphemeAnnotations", F.lit("M")).when(label == "LearnerErrorAnnotations", F.lit("E"))


def sentences(shredded: DataFrame) -> DataFrame:
    """One row for each sentence, with its text and character range."""
    rows = _entities(shredded, "SENTENCE", lambda n: F.struct(n["parent"].alias("parent"), _scalar(n, "s").alias("text"), _scalar(n, "@from").alias("from_at"), _scalar(n, "@to").alias("to_at")))
    return rows.filter("parent is null").drop("parent")


def words(shredded: DataFrame) -> DataFrame:
    """One row for each word of each section; ``sentence_id`` leads to its sentence."""
    return _entities(shredded, "word", lambda n: F.struct(_section(_above(n)).alias("section"), n["ordinal"].alias("word_no"), _scalar(n, "w").alias("w"))).filter("section is not null")


def _place(n: Column) -> list[Column]:
    word = _above(n)
    return [F.when(word["label"] == "word", _section(_above(word))).alias("section"), word["ordinal"].alias("word_no"), n["ordinal"].alias("morph_no")]


def morphs(shredded: DataFrame) -> DataFrame:
    """One row for each morph; (sentence_id, section, word_no) leads to its word."""
    labels = {"#text": "text", "@pos": "pos", "@from": "from_at", "@to": "to_at", "@subsequence": "subsequence", "@analyzedType": "analyzed_type", "@wordStart": "word_start", "Preserved": "preserved", "Removed": "removed"}

    def made(n: Column) -> Column:
        # one level deeper: Proofread (a text, or an object with a tag), ErrorArea, ErrorPattern, ErrorLevel
        proofread = _child(n, "Proofread")
        inner = lambda label: _scalar(_child(n, label), "@type")
        return F.struct(
            *_place(n), *(_scalar(n, a).alias(b) for a, b in labels.items()),
            F.coalesce(_scalar(proofread, "#text"), proofread["scalar"]).alias("proofread"), _scalar(proofread, "@pos").alias("proofread_pos"),
            inner("ErrorArea").alias("error_area"), inner("ErrorPattern").alias("error_pattern"), inner("ErrorLevel").alias("error_level"),
        )

    return _entities(shredded, "morph", made).filter("section is not null")


def annotated_records(shredded: DataFrame) -> DataFrame:
    """One row for each record with what proof-reading needs, gathered within the record: ``original``, the
    ``words`` of the morpheme section, and the ``annotated`` words of the error section with their morphs."""
    words = lambda section: F.filter("nodes", lambda n: (n["label"] == "word") & n["is_object"] & (_section(_above(n)) == section))

    def morph(n: Column) -> Column:
        proofread = _child(n, "Proofread")
        return F.struct(_scalar(n, "Preserved").alias("preserved"), _scalar(n, "Removed").alias("removed"), F.coalesce(_scalar(proofread, "#text"), proofread["scalar"]).alias("proofread"), _scalar(proofread, "@pos").alias("proofread_pos"))

    def wrong(n: Column) -> Column:
        below = F.slice(F.col("nodes"), n["child_from"] + 1, n["n_children"])
        return F.struct(_scalar(n, "w").alias("w"), F.transform(F.filter(below, lambda c: (c["label"] == "morph") & c["is_object"]), morph).alias("morphs"))

    root = F.get(F.col("nodes"), F.lit(0))
    rows = shredded.filter((root["label"] == "SENTENCE") & root["is_object"])
    return rows.select("sentence_id", "body_key", F.rtrim(_scalar(root, "s")).alias("original"), F.transform(words("M"), lambda n: F.struct(_scalar(n, "w").alias("w"))).alias("words"), F.filter(F.transform(words("E"), wrong), lambda w: F.size(w["morphs"]) > 0).alias("annotated"))


def morph_places(shredded: DataFrame) -> DataFrame:
    """Distinct (sentence_id, section, word_no, morph_no) of every morph element."""
    return _entities(shredded, "morph", lambda n: F.struct(*_place(n))).filter("section is not null").drop("body_key").distinct()
