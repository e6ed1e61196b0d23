"""Scans of configuration exports: metadata XML, rights, subsystems, report schemas, forms, modules, help pages, reports.

Files are read with Spark's own sources (``binaryFile`` / ``text``), so listing, splitting and pruning are Spark's; each
file is parsed where it is read.  Damaged files give a row with ``error`` instead of failing the scan.
"""

from __future__ import annotations

import html
import re
import struct
import xml.etree.ElementTree as ET
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHILD = T.StructType([T.StructField(n, T.StringType()) for n in ("kind", "name", "uuid", "synonym", "section")] + [T.StructField("types", T.ArrayType(T.StringType()))])
OBJECT = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("path", "type", "name", "uuid", "synonym", "comment")]
    + [T.StructField("properties", T.MapType(T.StringType(), T.StringType())), T.StructField("children", T.ArrayType(CHILD)), T.StructField("error", T.StringType())]
)


def local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _text(e: ET.Element | None) -> str:
    return "" if e is None else " ".join(" ".join(e.itertext()).split())


def _find(e: ET.Element | None, name: str) -> ET.Element | None:
    return next((x for x in e if local(x.tag) == name), None) if e is not None else None


def _child(e: ET.Element, section: str | None) -> dict:
    p = _find(e, "Properties")
    kinds = [_text(t) for t in (_find(p, "Type") if _find(p, "Type") is not None else []) if local(t.tag) in ("Type", "TypeSet")]
    return {"kind": local(e.tag), "name": _text(_find(p, "Name")), "uuid": e.get("uuid"), "synonym": _text(_find(p, "Synonym")), "section": section, "types": kinds}


def parse_object(path: str, data: bytes) -> dict:
    """One metadata object: type, name, properties by tag, children with their types."""
    row = dict.fromkeys((f.name for f in OBJECT.fields), None) | {"path": path, "properties": {}, "children": []}
    try:
        root = ET.fromstring(data)
    except ET.ParseError as e:
        return row | {"error": str(e)}
    top = next((x for x in root if x.get("uuid") or _find(x, "Properties") is not None), None) if local(root.tag) == "MetaDataObject" else root
    if top is None:
        return row | {"error": "no object"}
    p = _find(top, "Properties")
    row |= {"type": local(top.tag), "uuid": top.get("uuid"), "name": _text(_find(p, "Name")), "synonym": _text(_find(p, "Synonym")), "comment": _text(_find(p, "Comment"))}
    row["properties"] = {local(x.tag): _text(x) for x in (p if p is not None else [])}
    for c in _find(top, "ChildObjects") if _find(top, "ChildObjects") is not None else []:
        if _find(c, "Properties") is None:
            row["children"].append({"kind": local(c.tag), "name": _text(c), "uuid": None, "synonym": None, "section": None, "types": []})
            continue
        row["children"].append(_child(c, None))
        for sub in _find(c, "ChildObjects") if _find(c, "ChildObjects") is not None else []:
            row["children"].append(_child(sub, row["children"][-1]["name"]) if _find(sub, "Properties") is not None else {"kind": local(sub.tag), "name": _text(sub), "uuid": None, "synonym": None, "section": None, "types": []})
    return row


def _files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)


def _scan(df: DataFrame, parse, schema: T.StructType) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [r for p, c in zip(b["path"], b["content"]) for r in parse(p, bytes(c))]
            yield pd.DataFrame(rows, columns=[f.name for f in schema.fields])

    return df.select("path", "content").mapInPandas(run, schema)


def scan_objects(spark: SparkSession, path: str) -> DataFrame:
    """Every metadata object below a folder."""
    return _scan(_files(spark, path, "*.xml"), lambda p, c: [parse_object(p, c)], OBJECT)


def scan_mdo(spark: SparkSession, path: str) -> DataFrame:
    """Objects of a project in the flat per-object format (``.mdo``): the root element is the object."""

    def parse(p: str, c: bytes) -> list[dict]:
        row = dict.fromkeys((f.name for f in OBJECT.fields), None) | {"path": p, "properties": {}, "children": []}
        try:
            root = ET.fromstring(c)
        except ET.ParseError as e:
            return [row | {"error": str(e)}]
        row |= {"type": local(root.tag), "uuid": root.get("uuid"), "name": _text(_find(root, "name")), "comment": _text(_find(root, "comment"))}
        syn = _find(root, "synonym")
        row["synonym"] = _text(_find(syn, "value")) if syn is not None else ""
        for e in root:
            if _find(e, "name") is not None and e.get("uuid"):
                row["children"].append({"kind": local(e.tag), "name": _text(_find(e, "name")), "uuid": e.get("uuid"), "synonym": _text(_find(_find(e, "synonym"), "value")), "section": None, "types": [_text(t) for t in (_find(e, "type") if _find(e, "type") is not None else [])]})
            elif len(e) == 0:
                row["properties"][local(e.tag)] = (e.text or "").strip()
        return [row]

    return _scan(_files(spark, path, "*.mdo"), parse, OBJECT)


def object_statistics(objects: DataFrame) -> DataFrame:
    """type, objects, attributes, sections, forms."""
    count = lambda k: F.size(F.filter("children", lambda c: c["kind"] == k))
    return objects.groupBy("type").agg(F.count(F.lit(1)).alias("objects"), F.sum(count("Attribute")).alias("attributes"), F.sum(count("TabularSection")).alias("sections"), F.sum(count("Form")).alias("forms"))


def reference_edges(objects: DataFrame) -> DataFrame:
    """src, dst, relation, detail: references in the types of attributes; references to itself are dropped."""
    ref = r"(Catalog|Document|Enum|ChartOfCharacteristicTypes|ChartOfAccounts|ChartOfCalculationTypes|ExchangePlan|BusinessProcess|Task)Ref\.(\w+)"
    child = objects.select(F.concat_ws(".", "type", "name").alias("src"), F.explode("children").alias("c")).select("src", F.col("c.name").alias("detail"), F.col("c.section").alias("section"), F.explode("c.types").alias("t"))
    named = child.select("src", "detail", "section", F.regexp_extract("t", "(?U)" + ref, 1).alias("k"), F.regexp_extract("t", "(?U)" + ref, 2).alias("n")).where("k <> ''")
    relation = F.when(F.col("section").isNull(), "attribute").otherwise("tabular_section")
    return named.select("src", F.concat_ws(".", "k", "n").alias("dst"), relation.alias("relation"), "detail").where("src <> dst")


RIGHT = T.StructType([T.StructField(n, T.StringType()) for n in ("path", "object", "right", "value", "restriction")])


def scan_rights(spark: SparkSession, path: str) -> DataFrame:
    """object, right, value and the row-level restriction of every Rights.xml."""

    def parse(p: str, c: bytes) -> list[dict]:
        out = []
        for o in ET.fromstring(c):
            if local(o.tag) != "object":
                continue
            for r in o:
                if local(r.tag) == "right":
                    out.append({"path": p, "object": _text(_find(o, "name")), "right": _text(_find(r, "name")), "value": _text(_find(r, "value")), "restriction": _text(_find(_find(r, "restrictionByCondition"), "condition")) or None})
        return out

    return _scan(_files(spark, path, "Rights.xml"), parse, RIGHT)


FIELD = T.StructType([T.StructField(n, T.StringType()) for n in ("path", "part", "dataset", "name", "title", "expression")] + [T.StructField("groups", T.ArrayType(T.StringType()))])


def scan_report_schemas(spark: SparkSession, path: str, glob: str = "*.xml") -> DataFrame:
    """Fields of report schemas: part is 'dataset', 'calculated' or 'total'; all groups of a total are kept."""

    def parse(p: str, c: bytes) -> list[dict]:
        out = []
        root = ET.fromstring(c)
        for e in root.iter():
            tag = local(e.tag)
            if tag == "dataSet":
                for f in e:
                    if local(f.tag) == "field":
                        out.append({"path": p, "part": "dataset", "dataset": _text(_find(e, "name")), "name": _text(_find(f, "dataPath")) or _text(_find(f, "field")), "title": _text(_find(f, "title")), "expression": _text(_find(e, "query")) or None, "groups": []})
            elif tag in ("calculatedField", "totalField"):
                groups = [_text(g) for g in e if local(g.tag) == "group"]
                out.append({"path": p, "part": "calculated" if tag == "calculatedField" else "total", "dataset": None, "name": _text(_find(e, "dataPath")), "title": _text(_find(e, "title")), "expression": _text(_find(e, "expression")), "groups": groups})
        return out

    return _scan(_files(spark, path, glob), parse, FIELD)


ITEM = T.StructType([T.StructField(n, T.StringType()) for n in ("path", "item_path", "kind", "name", "data_path")] + [T.StructField("depth", T.IntegerType())])


def scan_forms(spark: SparkSession, path: str, glob: str = "Form.xml") -> DataFrame:
    """Items of forms, flattened with the path of names to each."""

    def parse(p: str, c: bytes) -> list[dict]:
        out: list[dict] = []

        def walk(e: ET.Element, trail: str, depth: int) -> None:
            for x in _find(e, "ChildItems") if _find(e, "ChildItems") is not None else []:
                name = x.get("name") or ""
                here = f"{trail}/{name}" if trail else name
                out.append({"path": p, "item_path": here, "kind": local(x.tag), "name": name, "data_path": _text(_find(x, "DataPath")) or None, "depth": depth})
                walk(x, here, depth + 1)

        walk(ET.fromstring(c), "", 0)
        return out

    return _scan(_files(spark, path, glob), parse, ITEM)


def scan_modules(spark: SparkSession, path: str) -> DataFrame:
    """path, module, code of source modules, read whole."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.bsl").text(path, wholetext=True).withColumn("path", F.input_file_name())
    return raw.select("path", F.regexp_extract("path", r"/([^/]+)/Ext/", 1).alias("module"), F.col("value").alias("code"))


# -- help pages
def strip_html(c):
    """Text of a page: tags off, common entities resolved, white space collapsed."""
    bare = F.regexp_replace(F.regexp_replace(c, r"(?is)<(script|style)[^>]*>.*?</\1>", " "), r"<[^>]*>", " ")
    for name, ch in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(name), F.lit(ch))
    return F.trim(F.regexp_replace(bare, r"[\s ]+", " "))


# fixed values: execution contexts named in help pages
FLAGS = {"server": r"(?iu)(?<!\p{L})(сервер|server)", "thin_client": r"(?iu)тонкий клиент|thin client", "web_client": r"(?iu)веб-клиент|web client", "thick_client": r"(?iu)толстый клиент|thick client", "mobile": r"(?iu)мобильн|mobile", "external": r"(?iu)внешнее соединение|external connection"}


def help_pages(pages: DataFrame, key: str, page: str) -> DataFrame:
    """key, title, version_since, version_deprecated and availability flags of help pages."""
    text = strip_html(F.col(page))
    some = lambda p: F.nullif(F.regexp_extract(text, p, 1), F.lit(""))
    return pages.select(
        key,
        strip_html(F.regexp_extract(page, r"(?is)<h1[^>]*>(.*?)</h1>", 1)).alias("title"),
        some(r"(?iu)(?:начиная с версии|since version|доступен с)\s+([0-9]+(?:\.[0-9]+)*)").alias("version_since"),
        some(r"(?iu)(?:не рекомендуется с версии|устарел с|deprecated since)\s+([0-9]+(?:\.[0-9]+)*)").alias("version_deprecated"),
        *(text.rlike(p).alias(n) for n, p in FLAGS.items()),
    )


# -- containers
ENTRY = T.StructType([T.StructField("path", T.StringType()), T.StructField("name", T.StringType()), T.StructField("size", T.LongType()), T.StructField("content", T.BinaryType())])
_BLOCK = re.compile(rb"\r\n([0-9a-f]{8,16}) ([0-9a-f]{8,16}) ([0-9a-f]{8,16}) \r\n")


def read_container(data: bytes) -> list[tuple[str, bytes]]:
    """(name, content) of a container's files; content is inflated where it is deflated.

    A container begins with the address of the first free block, then comes the table of contents as a chain of blocks:
    each block has its data size, its own size and the next block's address in hexadecimal between line ends.
    """
    wide = data[:8] == b"\xff" * 8
    head, none = (20, 0xFFFFFFFFFFFFFFFF) if wide else (16, 0x7FFFFFFF)

    def chain(at: int) -> bytes:
        out, size, seen = b"", None, set()
        while at != none and at not in seen and at < len(data):
            seen.add(at)
            m = _BLOCK.match(data, at)
            if not m:
                break
            total, own, following = (int(x, 16) for x in m.groups())
            size = total if size is None else size
            out += data[m.end() : m.end() + own]
            at = following
        return out[: size or 0]

    step = struct.calcsize("<QQQ" if wide else "<III")
    files = []
    toc = chain(head)
    for i in range(0, len(toc) - step + 1, step):
        name_at, data_at, _ = struct.unpack_from("<QQQ" if wide else "<III", toc, i)
        header = chain(name_at)
        name = header[20:].decode("utf-16-le", "ignore").rstrip("\0")
        body = chain(data_at) if data_at != none else b""
        try:
            body = zlib.decompress(body, -15)
        except zlib.error:
            pass
        files.append((name, body))
    return files


def _open_all(p: str, c: bytes) -> list[dict]:
    out, waiting = [], [("", c)]
    while waiting:  # containers within containers, however deep
        prefix, data = waiting.pop()
        for name, body in read_container(data):
            out.append({"path": p, "name": prefix + name, "size": len(body), "content": body})
            if body[:4] in (b"\xff\xff\xff\x7f", b"\xff\xff\xff\xff") and body != data:
                waiting.append((f"{prefix}{name}/", body))
    return out


def scan_containers(spark: SparkSession, path: str, glob: str = "*.c[f]*") -> DataFrame:
    """Files inside binary containers, nested ones opened too."""
    return open_containers(_files(spark, path, glob))


def open_containers(files: DataFrame) -> DataFrame:
    """path, name, size, content of the files inside the containers of a table (path, content)."""
    return _scan(files, _open_all, ENTRY)


def unescape_pages(df: DataFrame, column: str) -> DataFrame:
    """Entities of every kind resolved (for pages with rare ones)."""

    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda t: html.unescape(t) if isinstance(t, str) else None)

    return df.withColumn(column, run(column))


# -- further parts of an export
VERSION = T.StructType([T.StructField(n, T.StringType()) for n in ("path", "name", "id", "config_version")])


def scan_dump_info(spark: SparkSession, path: str) -> DataFrame:
    """name, id and version of every object in ConfigDumpInfo.xml, nested ones too."""

    def parse(p: str, c: bytes) -> list[dict]:
        return [{"path": p, "name": e.get("name"), "id": e.get("id"), "config_version": e.get("configVersion")} for e in ET.fromstring(c).iter() if local(e.tag) == "Metadata" and e.get("name")]

    return _scan(_files(spark, path, "ConfigDumpInfo.xml"), parse, VERSION)


def configuration(objects: DataFrame) -> DataFrame:
    """name, synonym, version, vendor, compatibility and the list of objects of Configuration.xml."""
    p = lambda k: F.try_element_at("properties", F.lit(k))
    own = objects.where("type = 'Configuration'")
    return own.select("name", "synonym", p("Version").alias("version"), p("Vendor").alias("vendor"), p("CompatibilityMode").alias("compatibility"), F.transform("children", lambda c: F.concat_ws(".", c["kind"], c["name"])).alias("objects"))


def config_index(objects: DataFrame, versions: DataFrame) -> DataFrame:
    """The objects that Configuration.xml lists, with what their own files and the dump's versions say: type, name, uuid,
    synonym, config_version; a listed object without a file stays, with nulls."""
    listed = configuration(objects).select(F.explode("objects").alias("full_name"))
    own = objects.where("type <> 'Configuration' AND error IS NULL").select(F.concat_ws(".", "type", "name").alias("full_name"), "uuid", "synonym")
    dumped = versions.select(F.col("name").alias("full_name"), "config_version").dropDuplicates(["full_name"])
    joined = listed.join(own, "full_name", "left").join(dumped, "full_name", "left")
    return joined.select(F.substring_index("full_name", ".", 1).alias("type"), F.expr("substring(full_name, instr(full_name, '.') + 1)").alias("name"), "uuid", "synonym", "config_version")


def subsystem_contents(objects: DataFrame) -> DataFrame:
    """subsystem, object: what each subsystem holds."""
    return objects.where("type = 'Subsystem'").select(F.col("name").alias("subsystem"), F.explode(F.regexp_extract_all(F.coalesce(F.try_element_at("properties", F.lit("Content")), F.lit("")), F.lit(r"([\p{L}\p{N}_]+\.[\p{L}\p{N}_]+)"), F.lit(1))).alias("object"))


def subscriptions(objects: DataFrame) -> DataFrame:
    """name, kind, source, event, handler, schedule of event subscriptions and scheduled jobs."""
    p = lambda k: F.try_element_at("properties", F.lit(k))
    return objects.where("type IN ('EventSubscription', 'ScheduledJob')").select("name", F.col("type").alias("kind"), p("Source").alias("source"), p("Event").alias("event"), F.coalesce(p("Handler"), p("MethodName")).alias("handler"), p("Schedule").alias("schedule"))


def listing_edges(objects: DataFrame) -> DataFrame:
    """src, dst, relation, detail beyond attribute references: recorders, subsystems and subscriptions."""
    ref = r"(Catalog|Document|Enum|InformationRegister|AccumulationRegister|AccountingRegister)(?:Ref|Object|RecordSet)?\.([\p{L}\p{N}_]+)"

    def named(df: DataFrame, src: str, text: str, relation: str) -> DataFrame:
        each = df.select(F.col(src).alias("src"), F.explode(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(ref), F.lit(0))).alias("m"))
        return each.select("src", F.concat_ws(".", F.regexp_extract("m", ref, 1), F.regexp_extract("m", ref, 2)).alias("dst"), F.lit(relation).alias("relation"), F.lit("").alias("detail"))

    p = lambda k: F.try_element_at("properties", F.lit(k))
    full = objects.where("error IS NULL").withColumn("full", F.concat_ws(".", "type", "name"))
    recorders = full.where("type = 'Document'").withColumn("text", p("RegisterRecords"))
    contents = subsystem_contents(objects).select(F.concat(F.lit("Subsystem."), "subsystem").alias("full"), F.col("object").alias("text"))
    subs = subscriptions(objects).where("kind = 'EventSubscription'").select(F.concat(F.lit("EventSubscription."), "name").alias("full"), F.col("source").alias("text"))
    return named(recorders, "full", "text", "recorder").unionByName(named(contents, "full", "text", "subsystem")).unionByName(named(subs, "full", "text", "subscription")).distinct()


def scan_listing(spark: SparkSession, path: str) -> DataFrame:
    """path, name, length of every file below the folders called Ext; contents are not read."""
    files = _files(spark, path, "*").select("path", "length")
    return files.where(F.col("path").contains("/Ext/")).select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "length")


def scan_linter_report(spark: SparkSession, path: str) -> DataFrame:
    """path, line, code, severity, message of an external linter's JSON report."""
    place = "struct<start:struct<line:int>>"
    schema = f"fileinfos array<struct<path:string, diagnostics:array<struct<code:string, severity:string, message:string, range:{place}>>>>"
    read = spark.read.schema(schema).option("multiLine", "true").json(path)
    files = read.select(F.explode("fileinfos").alias("f")).select(F.col("f.path").alias("path"), F.explode("f.diagnostics").alias("d"))
    return files.select("path", (F.col("d.range.start.line") + 1).alias("line"), F.col("d.code").alias("code"), F.col("d.severity").alias("severity"), F.col("d.message").alias("message"))


def scan_knowledge(spark: SparkSession, path: str) -> DataFrame:
    """id, title, category, keywords, content of a knowledge base: an index.json and the Markdown files it names."""
    item = "struct<id:string, title:string, file:string, keywords:array<string>>"
    index = spark.read.schema(f"categories map<string, struct<items:array<{item}>>>").option("multiLine", "true").json(f"{path}/index.json")
    items = index.select(F.explode("categories").alias("category", "c")).select("category", F.inline("c.items"))
    texts = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("f"), F.col("value").alias("content"))
    return items.withColumn("f", F.regexp_extract("file", r"([^/]+)$", 1)).join(texts, "f", "left").select("id", "title", "category", "keywords", "content")


def scan_help_books(spark: SparkSession, path: str, glob: str = "*.hbk") -> DataFrame:
    """Pages of help books: a container whose file storage is a ZIP archive; path, page, html."""
    import io
    import zipfile

    schema = T.StructType([T.StructField(n, T.StringType()) for n in ("path", "page", "html")])

    def parse(p: str, c: bytes) -> list[dict]:
        out = []
        for name, body in [*read_container(c), ("", c)]:
            if body[:4] != b"PK\x03\x04":
                continue
            with zipfile.ZipFile(io.BytesIO(body)) as z:
                out += [{"path": p, "page": i.filename, "html": z.read(i).decode("utf-8-sig", "replace")} for i in z.infolist() if not i.is_dir()]
        return out

    return _scan(_files(spark, path, glob), parse, schema)
