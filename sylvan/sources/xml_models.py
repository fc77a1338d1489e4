"""Descriptors and models written as XML, streamed: memory grows with the depth of a document, not with its size."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import IO
from xml.etree import ElementTree
from xml.parsers import expat

from .rows import NODE_TABLES, split_ref

Row = tuple[str, dict]
#: Bytes that go to the parser at once.
CHUNK = 1 << 16
#: Bytes of a model up to which it is held as a tree, some ten times as large, which takes a fraction of a parser's calls.
TREE = 1 << 20
#: Beginnings of models that are kept read, as the files of a model's roots have the same.
HEADS = 16
_SAID = '"([^"<\n\t]*)"'
_REF = f'<(ref)( role={_SAID})?( to={_SAID})?( node={_SAID})?( resolve={_SAID})? ?/>'
_TAGS = f'<(property) role={_SAID} value={_SAID} ?/>|<(node) concept={_SAID} id={_SAID}( role={_SAID})?( ?/)?>|<(/node)>|<(/model)>[ \n\t]*\\Z'
#: Nodes as they are usually written, with and without references; the last group has all from what is none of these.
_WITH_REFS = re.compile(f"[ \n\t]*(?:{_TAGS}|{_REF}|([\\s\\S]+))")
_WITHOUT = re.compile(f"(?:[ \n\t]*{re.sub('[(](?![?])', '(?:', _REF)})*[ \n\t]*(?:{_TAGS}|([\\s\\S]+))")
#: What has to be decoded, or is no XML.
_ODD = re.compile("[\0-\x08\x0b-\x1f&\ufffe\uffff]")
#: Tables that have rows of what comes before the nodes.
_BEFORE = {"models", "model_imports", "model_languages", "registry"}


def check(stream: IO[bytes]) -> None:
    """Raises where the document is not well formed, so that a broken file yields no rows at all."""
    expat.ParserCreate().ParseFile(stream)
    stream.seek(0)


def descriptor(stream: IO[bytes], place: dict) -> Iterator[Row]:
    """The module of a solution's or language's descriptor, and the dependencies of the module itself (not those of its generators)."""
    top = ElementTree.parse(stream).getroot()
    kind = "language" if top.tag == "language" else "solution"
    own = top.get("uuid")
    name = top.get("namespace" if kind == "language" else "name")
    version = int(top.get("languageVersion", "0")) if kind == "language" else None
    yield "modules", {"scan_ord": place["scan_ord"], "module_id": own, "name": name, "kind": kind, "version": version, "dir": place["dir"], "path": place["path"], "jar": place["jar"]}
    for k, dep in enumerate(top.findall("dependencies/dependency")):
        dep_id, dep_name = split_ref((dep.text or "").strip())
        yield "module_deps", {"module_id": own, "dir": place["dir"], "dep_module_id": dep_id, "dep_name": dep_name, "ord": k}


class Columns:
    """Rows of one table as tuples of ``names``; ``same`` are columns that have one value in all of them."""

    def __init__(self, *names: str, same: dict):
        self.names, self.same = names, same
        self.rows: list[tuple] = []
        self.sizes: list[int] = []
        self.entries: tuple[list, list] = [], []  # keys and values of ``props``, of which each row has so many


class _Enough(Exception):
    """Nobody wants what follows."""


class _Reader:
    """The rows of one file, collected while a parser goes over it.

    pre numbers the file's nodes in document order from 1, last is the largest number in a node's subtree.
    """

    def __init__(self, place: dict, wanted: set[str]):
        self.place, self.wanted, self.where = place, wanted, {"source": place["source"], "path": place["path"]}
        self.models, self.concepts, self.properties, self.kids, self.links = {}, {}, {}, {}, {}  # what the short indices of the file stand for
        self.holds, self.refers = bool(NODE_TABLES & wanted), "node_refs" in wanted
        self.head, self.name, self.flag, self.told = {}, None, False, False
        self.imports = self.languages = self.registered = self.pre = 0
        self.tags: list[str | dict] = []  # a concept's attributes stand for its tag
        self.above: list[list] = []  # open nodes: id, root, concept, role, ord, pre, properties, references and children so far
        self.language = self.concept = None
        self.tops = 0
        self.rows: list[Row] = []
        self.blank()

    def blank(self) -> None:
        same = self.head | self.where
        self.nodes = Columns("node_id", "parent_id", "root_id", "concept", "role", "ord", "depth", "pre", "last", same=same)
        self.refs = Columns("node_id", "pre", "role", "ord", "target_model_id", "target_node_id", "resolve_info", same=same)

    def taken(self, least: int) -> Iterator[Row]:
        """What was collected, nodes and references if there are as many as ``least``."""
        yield from self.rows
        self.rows.clear()
        if len(self.nodes.rows) + len(self.refs.rows) >= least:
            nodes, refs = self.nodes, self.refs
            self.blank()
            if nodes.rows:
                yield "nodes", nodes
            if refs.rows:
                yield "node_refs", refs

    def model_row(self) -> None:
        self.told = True
        self.rows.append(("models", self.head | {"scan_ord": self.place["scan_ord"], "name": self.name, "dir": self.place["dir"], **self.where, "persistency": self.place["persistency"], "is_do_not_generate": self.flag}))

    def start(self, tag: str, a: dict) -> None:
        tags = self.tags
        if not tags:
            own, self.name = split_ref(a.get("ref"))
            self.head = {"model_id": own}
            self.blank()
        elif tag == "property" and tags[-1] == "node":
            self.property(a)
        elif tag == "ref":
            self.ref(a)
        elif tag == "node":
            if not self.holds:
                raise _Enough
            self.pre += 1
            above, own, concept = self.above, a.get("id"), a.get("concept")
            if concept in self.concepts:
                concept = self.concepts[concept]
            if above:
                up, role = above[-1], a.get("role")
                at, root = up[8], up[1]
                up[8] = at + 1
                if role in self.kids:
                    role = self.kids[role]
            else:
                at, self.tops, root, role = self.tops, self.tops + 1, own, None
            above.append([own, root, concept, role, at, self.pre, None, 0, 0])
        elif tag == "language":
            if tags[-1] == "registry":
                self.language = a
        elif tag == "concept":
            self.concept = a
            self.concepts[a.get("index")] = a.get("name")
            self._register(None, {})
            tags.append(a)
            return
        elif self.concept is not None and tag in ("property", "child", "reference") and tags[-1] is self.concept:
            members = self.properties if tag == "property" else self.kids if tag == "child" else self.links
            if a.get("index") is not None:
                members[a["index"]] = a.get("name")
            self._register(tag, a)
        elif tag == "attribute":
            if len(tags) == 1 and a.get("name") == "doNotGenerate":
                self.flag = a.get("value") == "true"
        elif tag == "import":
            target, name = split_ref(a.get("ref"))
            self.models[a.get("index")] = target
            self.rows.append(("model_imports", self.head | self.where | {"import_index": a.get("index"), "imported_model_id": target, "imported_name": name, "implicit": a.get("implicit") == "true", "ord": self.imports}))
            self.imports += 1
        elif tag == "use":
            self.rows.append(("model_languages", self.head | {"source": self.place["source"], "language_id": a.get("id"), "language_name": a.get("name"), "version": int(a.get("version") or 0), "ord": self.languages}))
            self.languages += 1
        tags.append(tag)

    def property(self, a: dict) -> None:
        if self.above:
            own, key = self.above[-1], a.get("role")
            if key in self.properties:
                key = self.properties[key]
            if own[6] is None:
                own[6] = {key: a.get("value")}
            elif key not in own[6]:
                own[6][key] = a.get("value")

    def ref(self, a: dict) -> None:
        if self.above and self.refers:
            own = self.above[-1]
            to, role = a.get("to"), a.get("role")
            index, colon, target = to.partition(":") if to else ("", "", "")
            if role in self.links:
                role = self.links[role]
            if colon:
                self.refs.rows.append((own[0], own[5], role, own[7], self.models.get(index), target, a.get("resolve")))
            else:
                self.refs.rows.append((own[0], own[5], role, own[7], self.head["model_id"], a.get("node"), a.get("resolve")))
            own[7] += 1

    def like(self, other: _Reader) -> None:
        """As if what comes before the nodes had been read, without its rows."""
        self.models, self.concepts, self.properties, self.kids, self.links, self.head = other.models, other.concepts, other.properties, other.kids, other.links, other.head
        self.blank()

    def plain(self, text: str) -> bool:
        """Reads nodes, up to the end of the model, that are written as usual; false if they aren't, or not well formed."""
        if _ODD.search(text):
            return False
        concepts, properties, kids, rows, sizes = self.concepts, self.properties, self.kids, self.nodes.rows, self.nodes.sizes
        keys, values = self.nodes.entries
        above, pre, tops, over = [], 0, 0, False
        for prop, key, value, node, concept, own_id, has_role, role, shut, end, last, *ref, odd in (_WITH_REFS if self.refers else _WITHOUT).findall(text):
            if prop:
                if above:
                    own = above[-1]
                    if key in properties:
                        key = properties[key]
                    if own[6] is None:
                        own[6] = {key: value}
                    elif key not in own[6]:
                        own[6][key] = value
                continue
            if node:
                pre += 1
                if concept in concepts:
                    concept = concepts[concept]
                if above:
                    up = above[-1]
                    at, root = up[8], up[1]
                    up[8] = at + 1
                    role = kids.get(role, role) if has_role else kids.get(None)
                else:
                    at, tops, root, role = tops, tops + 1, own_id, None
                above.append([own_id, root, concept, role, at, pre, None, 0, 0])
                if not shut:
                    continue
            elif not end:
                if odd or over:
                    return False
                if last:
                    over = True
                elif ref and ref[0]:
                    self.above = above
                    self.ref({k: v for k, has, v in zip(("role", "to", "node", "resolve"), ref[1::2], ref[2::2]) if has})
                continue
            elif not above:
                return False
            own_id, root, concept, role, at, first, props, _, _ = above.pop()
            rows.append((own_id, above[-1][0] if above else None, root, concept, role, at, len(above), first, pre))
            if props is None:
                sizes.append(0)
            else:
                sizes.append(len(props))
                keys.extend(props)
                values.extend(props.values())
        return over and not above

    def walk(self, top: ElementTree.Element, over: bool = True) -> None:
        """Goes over a document as a parser would that calls ``start`` and ``end``; properties and references of nodes need only one of these.
        If it isn't ``over``, more follows."""
        start, end = self.start, self.end
        start(top.tag, top.attrib)
        above = [(top.tag, iter(top))]
        while above:
            tag, inside = above[-1]
            for e in inside:
                own = e.tag
                if own == "ref" and not len(e):
                    if self.refers:
                        self.ref(e.attrib)
                elif own == "property" and tag == "node" and not len(e):
                    self.property(e.attrib)
                else:
                    start(own, e.attrib)
                    above.append((own, iter(e)))
                    break
            else:
                above.pop()
                if above or over:
                    end(tag)

    def _register(self, kind: str | None, member: dict) -> None:
        if "registry" in self.wanted:
            self.rows.append(("registry", self.head | self.where | _registered(self.language, self.concept, kind, member, self.registered)))
        self.registered += 1

    def end(self, tag: str) -> None:
        self.tags.pop()
        if tag == "node":
            above = self.above
            own_id, root, concept, role, at, pre, props, _, _ = above.pop()
            nodes = self.nodes
            nodes.rows.append((own_id, above[-1][0] if above else None, root, concept, role, at, len(above), pre, self.pre))
            if props is None:
                nodes.sizes.append(0)
            else:
                nodes.sizes.append(len(props))
                nodes.entries[0].extend(props)
                nodes.entries[1].extend(props.values())
        elif (tag == "registry" or tag == "model") and self.place["lead"] and not self.told:
            self.model_row()


def model(stream: IO[bytes], place: dict, wanted: set[str], rows: int = 4096) -> Iterator[tuple[str, dict | Columns]]:
    """The rows of one file, nodes and references as Columns of some ``rows``; a file whose nodes nobody wants is read up to its first node."""
    reader = _Reader(place, wanted)
    parser = expat.ParserCreate(namespace_separator="}")
    parser.StartElementHandler, parser.EndElementHandler = reader.start, reader.end
    try:
        while block := stream.read(CHUNK):
            parser.Parse(block)
            yield from reader.taken(rows)
        parser.Parse(b"", True)
    except _Enough:
        pass
    if place["lead"] and not reader.told:
        reader.model_row()
    yield from reader.taken(0)


Heads = dict[bytes, tuple[ElementTree.Element, _Reader] | None]


def _head(data: bytes, heads: Heads) -> tuple[ElementTree.Element, _Reader] | None:
    """What comes before a model's nodes, if the rest can be read without it: it ends within the model's own tag and says nothing of how text is to be read."""
    if data not in heads:
        if len(heads) >= HEADS:
            heads.clear()
        heads[data] = None
        if not (b"<!" in data or b"xmlns" in data or b"encoding" in data.replace(b' encoding="UTF-8"?>', b"", 1)):
            try:
                top = ElementTree.fromstring(data + b"</model>")
            except (ElementTree.ParseError, ValueError, LookupError):
                return None
            if next(top.iter("node"), None) is not None:
                return None
            reader = _Reader({"source": None, "path": None, "lead": False}, set())
            reader.walk(top, over=False)
            heads[data] = top, reader
    return heads[data]


def small_model(data: bytes, place: dict, wanted: set[str], heads: Heads) -> list[tuple[str, dict | Columns]] | None:
    """As ``model``, of a file that is held whole; None if it can't be held as a tree, which ``check`` and ``model`` have to say.
    ``heads`` keeps what files begin with.  Nodes that are written as usual aren't made a tree."""
    at = data.find(b"<node ")
    if at > 0 and NODE_TABLES & wanted and (head := _head(data[:at], heads)):
        reader = _Reader(place, wanted)
        if _BEFORE & wanted:
            reader.walk(head[0], over=False)
        else:
            reader.like(head[1])
        try:
            usual = reader.plain(data[at:].decode())
        except UnicodeDecodeError:
            usual = False
        if usual:
            if place["lead"] and not reader.told:
                reader.model_row()
            return list(reader.taken(0))
    try:
        top = ElementTree.fromstring(data)
    except (ElementTree.ParseError, ValueError, LookupError):
        return None
    reader = _Reader(place, wanted)
    try:
        reader.walk(top)
    except _Enough:
        pass
    if place["lead"] and not reader.told:
        reader.model_row()
    return list(reader.taken(0))


def _registered(language: dict, concept: dict, kind: str | None, member: dict, at: int) -> dict:
    return {
        "language_id": language.get("id"), "language_name": language.get("name"), "concept_id": concept.get("id"), "concept_name": concept.get("name"), "flags": concept.get("flags"),
        "concept_index": concept.get("index"), "kind": kind, "member_id": member.get("id"), "member_name": member.get("name"), "member_index": member.get("index"), "ord": at,
    }
