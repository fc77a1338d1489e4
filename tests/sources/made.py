"""Repositories with made-up content: an XML text per file, and an encoder for the binary format."""

import struct
import zipfile
from pathlib import Path

GARDEN, CORE = "11111111-2222-3333-4444-555555555555", "aaaaaaaa-bbbb-cccc-dddd-eeeeeeeeeeee"
REGISTRY = f"""  <registry>
    <language id="{GARDEN}" name="garden">
      <concept id="900" name="garden.structure.Bed" flags="ng" index="b">
        <child id="901" name="plants" index="bp" />
      </concept>
      <concept id="910" name="garden.structure.Plant" flags="ng" index="p">
        <property id="911" name="height" index="ph" />
        <reference id="912" name="species" index="ps" />
      </concept>
    </language>
    <language id="{CORE}" name="core">
      <concept id="990" name="core.structure.Named" flags="ng" index="n">
        <property id="991" name="name" index="nn" />
      </concept>
    </language>
  </registry>
"""
TOP, SPECIES = "r:00000000-0000-0000-0000-000000000001(garden.top)", "r:00000000-0000-0000-0000-000000000002(garden.species)"
ROOT = f"""<?xml version="1.0" encoding="UTF-8"?>
<model ref="{TOP}" content="root">
  <persistence version="9" />
  <imports>
    <import index="sp" ref="{SPECIES}" implicit="true" />
  </imports>
{REGISTRY}  <node concept="b" id="1a">
    <property role="nn" value="north &amp; &quot;west&quot;" />
    <node concept="p" id="1b" role="bp">
      <property role="nn" value="Fern" />
      <property role="ph" value="40" />
      <ref role="ps" to="sp:2a" resolve="fern" />
    </node>
    <node concept="p" id="1c" role="bp">
      <property role="nn" value="Moss" />
      <ref role="ps" node="1b" resolve="Fern" />
    </node>
    <node concept="p" id="1d" role="bp">
      <ref role="ps" to="sp:9z" resolve="gone" />
    </node>
  </node>
</model>

"""


def single(ref: str, nodes: str = "", attribute: str = "", imports: str = "") -> str:
    return f'<model ref="{ref}"><persistence version="9" />{attribute}<languages><use id="{GARDEN}" name="garden" version="3" /></languages><imports>{imports}</imports>{REGISTRY}{nodes}</model>'


def solution(name: str, own: str, deps: str = "") -> str:
    return f'<solution name="{name}" uuid="{own}"><models><modelRoot /></models><dependencies>{deps}</dependencies><dependencyVersions><module reference="x(y)" version="0" /></dependencyVersions></solution>'


def write(top: Path, files: dict[str, str | bytes]) -> str:
    for name, text in files.items():
        path = top / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(top)


def garden(top: Path) -> str:
    """Two solutions: one a directory of roots, one with a model in one file; a language; a broken file; files that don't count."""
    header = f'<model ref="{TOP}" content="header"><persistence version="9" /><attribute name="doNotGenerate" value="true" /><imports><import index="sp" ref="{SPECIES}" /></imports></model>'
    return write(top, {
        "one/one.msd": solution("one", "m1", '<dependency reexport="false">m2(two)</dependency>'),
        "one/models/garden.top/.model": header,
        "one/models/garden.top/_north bed.mpsr": ROOT,
        "two/two.msd": solution("two", "m2"),
        "two/models/species.mps": single(SPECIES, '<node concept="p" id="2a"><property role="nn" value="fern" /></node><node concept="p" id="1b" />'),
        "two/models/broken.mps": "<model ref='r:3(x)'><node",
        "two/elsewhere/template.mps": single("r:4(template)"),
        "lang/lang.mpl": f'<language namespace="garden" uuid="{GARDEN}" languageVersion="7"><generators><generator><dependencies><dependency>no(no)</dependency></dependencies></generator></generators></language>',
        "lang/models/structure.mps": single("r:5(garden.structure)"),
    })


def archive(path: Path, folder: str) -> None:
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(Path(folder).rglob("*")):
            if f.is_file():
                z.write(f, f.relative_to(folder).as_posix())


class Encoder:
    """Writes what the decoder reads."""

    def __init__(self):
        self.out, self.seen = b"", {}

    def put(self, form: str, *values: int) -> "Encoder":
        self.out += struct.pack(">" + form, *values)
        return self

    def text(self, s: str | None) -> "Encoder":
        if s is None:
            return self.put("B", 0x70)
        if s in self.seen:
            return self.put("BI", 1, self.seen[s])
        self.seen[s] = len(self.seen)
        raw = s.encode()
        self.put("BH", 2, len(raw)).out += raw
        return self

    def model_ref(self, n: int, name: str) -> "Encoder":
        return self.put("BBQQ", 0x07, 0x28, 0, n).text(name).put("B", 0x70)


def binary(version: int = 2, depth: int = 1) -> bytes:
    """A bed that refers to itself, to an import, to a foreign model and to nothing known, above a chain of plants."""
    e = Encoder()
    e.put("II", 0x91ABABA9, 0x400 if version == 2 else 0x500)
    if version == 2:
        e.model_ref(11, "garden.binary").put("i", 0).put("BBh", 0x7E, 0, 1)
    else:
        e.put("B", 0x70).put("BQQ", 0x28, 0, 11).text("garden.binary").put("Bh", 0x7E, 1)
    e.text("doNotGenerate").text("true")
    if version == 3:
        e.put("B", 0)
    e.put("I", 0xABABABAB).put("I", 0x5A5A5A5A)
    e.put("HQQ", 1, 7, 8).text("garden").put("H", 2)
    e.put("Q", 900).text("Bed").put("BBQ", 1, 0x13, 5).put("H", 0).put("HQ", 1, 912).text("species").put("HQ", 1, 901).text("plants").put("B", 0)
    e.put("Q", 910).text("Plant").put("BB", 1, 0x12).put("HQ", 1, 991).text("name").put("HH", 0, 0)
    e.put("I", 0xA5A5A5A5)
    if version == 3:
        e.put("B", 1)
    e.put("HQQ", 1, 7, 8).text("garden")
    if version == 3:
        e.put("i", 4)
    e.put("HH", 0, 0).put("I", 1).model_ref(2, "garden.species")
    if version == 2:
        e.put("i", -1)
    e.put("I", 0xBABABABA).put("I", 1)
    e.put("HBQHB", 0, 0x18, 2**64 - 1, 0xFFFF, 0x7B).put("HH", 0, 1).text("user").put("H", 4)
    e.put("HBBQB", 0, 1, 0x18, 5, 0x11).text("self")
    e.put("HBBQBBI", 0, 1, 0x18, 74, 0x12, 0x09, 1).text("fern")
    e.put("HBB", 0, 1, 0x17).text("~String").put("BBB", 0x12, 0x07, 0x26).text("java:java.lang").text("java.lang").put("BB", 0x18, 2).put("H", 3).out += b"jdk"
    e.seen["jdk"] = len(e.seen)
    e.text("String")
    e.put("HBBB", 0, 1, 0x70, 0x33).text("odd")
    for k in range(depth):
        e.put("I", 1).put("HBQHB", 1, 0x18, k, 0, 0x7B).put("HH", 1, 0).text("Fern").put("HH", 0, 0)
    e.put("I", 0)
    return e.out + b"\x7d" * (depth + 1)
