"""Problems 2, 3, 4 and 6 against brute force in plain Python, on whole small tables and on edge cases."""

import datetime as dt
import json
import re
from collections import Counter, defaultdict

import pyarrow.parquet as pq

from ledgerloom import queries_general as g
from ledgerloom.operators import nested, packed, references, snapshots

KIND = {
    "справочник": "catalog", "документ": "document", "перечисление": "enum", "регистрсведений": "informationregister",
    "регистрнакопления": "accumulationregister", "планвидовхарактеристик": "chartofcharacteristictypes", "определяемыйтип": "definedtype",
}


def rows(data, name):
    return pq.read_table(f"{data}/{name}.parquet").to_pylist()


def tuples(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def ref_of(text):
    m = re.match(r"\s*(\w+?)(?:Ref|Ссылка)?\s*\.\s*(\w+)", text or "", re.I)
    kind = m and (KIND.get(m[1].lower()) or (m[1].lower() if m[1].lower() in KIND.values() else None))
    return f"{kind}.{m[2].lower()}" if kind else None


def load(text):
    try:
        v = json.loads(text)
        return json.loads(v) if isinstance(v, str) else v
    except (TypeError, ValueError):
        return None


def elements(v):
    if isinstance(v, list):
        return [(x.get("name") if isinstance(x, dict) else None, x) for x in v]
    if not isinstance(v, dict):
        return []
    if "data_type" in v or isinstance(v.get("name"), str):
        return [(v.get("name"), v)]
    out = []
    for k, x in v.items():
        if isinstance(x, list) and all(isinstance(y, dict) for y in x):
            out += elements(x)
        else:
            out.append((x.get("name", k) if isinstance(x, dict) else k, x))
    return out


def types_in(v):
    found = []
    for _, body in elements(v):
        found.append(body.get("data_type") if isinstance(body, dict) else body)
        if isinstance(body, dict):
            found += [a.get("data_type") if isinstance(a, dict) else a for _, a in elements(body.get("attributes"))]
    return " ; ".join(json.dumps(x, ensure_ascii=False) for x in found if x is not None)


def test_p2(spark, data):
    lives = {}
    for o in rows(data, "config_objects"):
        k = o["uuid"]
        if k not in lives or (o["loaded_at"], o["obj_id"]) > (lives[k]["loaded_at"], lives[k]["obj_id"]):
            lives[k] = o
    alive = defaultdict(list)
    for o in lives.values():
        alive[f"{o['object_type'].strip().lower()}.{o['object_name'].strip().lower()}"].append((o["created_at"], o["deleted_at"] or dt.datetime.max))
    refs = {("query_tables", r["qt_id"], ref_of(r["full_name"]), r["seen_at"]) for r in rows(data, "query_tables")}
    refs |= {("cfe_diffs", r["diff_id"], ref_of(x), r["run_at"]) for r in rows(data, "cfe_diffs") for x in r["not_in_config"] or []}
    for r in rows(data, "config_objects"):
        for part in re.findall(r"\w+(?:Ref|Ссылка)\.\w+|(?:DefinedType|ОпределяемыйТип)\.\w+", types_in(load(r["fields"])), re.I):
            refs.add(("config_objects", r["obj_id"], ref_of(part), r["loaded_at"]))
    refs = {x for x in refs if x[2] and x[3]}
    exists = lambda ref, t: any(a <= t < b for a, b in alive[ref])
    want = {(s, i, ref) for s, i, ref, t in refs if not exists(ref, t)}
    got = tuples(g.p2_found(spark, data), "src", "rec_id", "ref")
    assert got == sorted(want) and len(got) > 20

    # the cascade, record by record: what a record in force holds is passed on to what refers to it
    history = defaultdict(list)
    for o in sorted(rows(data, "config_objects"), key=lambda o: (o["loaded_at"], o["obj_id"])):
        history[f"{o['object_type'].strip().lower()}.{o['object_name'].strip().lower()}"].append((o["loaded_at"], o["obj_id"]))
    in_force = lambda ref, t: max(((a, i) for a, i in history[ref] if a <= t), default=(None, None))[1]
    level = {i: 0 for s, i, ref, t in refs if s == "config_objects" and not exists(ref, t)}
    links = [(i, in_force(ref, t)) for s, i, ref, t in refs if s == "config_objects" and exists(ref, t)]
    for depth in range(1, 1000):
        new = {i for i, p in links if i not in level and level.get(p) == depth - 1}
        level |= dict.fromkeys(new, depth)
        if not new:
            break
    months = Counter()
    for s, i, ref, t in refs:
        direct, held = not exists(ref, t), in_force(ref, t) in level
        if direct or held:
            months[s, f"{t:%Y-%m}", "direct" if direct else "inherited"] += 1
    report = {(r.src, r.month): (r.direct, r.inherited) for r in g.p2_report(spark, data).collect()}
    assert report == {(s, m): (months[s, m, "direct"], months[s, m, "inherited"]) for s, m, _ in months}
    assert sum(n for _, n in report.values()) > 0


def test_p2_cascade(spark):
    t = dt.datetime
    objects = spark.createDataFrame(
        [(1, "a", "Catalog", "А", t(2024, 1, 1), None, t(2024, 1, 2)), (2, "b", "Catalog", "Б", t(2024, 1, 1), None, t(2024, 1, 2)), (3, "c", "Catalog", "В", t(2024, 1, 1), t(2024, 3, 1), t(2024, 1, 2)), (4, "c", "Catalog", "В", t(2024, 1, 1), t(2024, 2, 1), t(2024, 1, 5)), (5, "d", None, None, None, None, None)],
        "obj_id long, uuid string, object_type string, object_name string, created_at timestamp, deleted_at timestamp, loaded_at timestamp",
    )
    refs = spark.createDataFrame(
        [("config_objects", 1, "catalog.нет", t(2024, 1, 3)), ("config_objects", 1, "catalog.б", t(2024, 1, 3)), ("config_objects", 2, "catalog.а", t(2024, 1, 3)), ("q", 9, "catalog.б", t(2024, 1, 3)), ("q", 8, "catalog.в", t(2024, 2, 1)), ("q", 7, "catalog.в", t(2024, 1, 31))],
        "src string, rec_id long, ref string, ts timestamp",
    )
    alive, records = references.lives(objects), references.deliveries(objects)
    got = tuples(references.orphans(refs, alive, records), "src", "rec_id", "ref", "depth")
    # rec 2 refers to А, which holds an orphan; q 9 refers to Б, which holds a reference to А; the cycle А <-> Б ends
    assert got == [("config_objects", 1, "catalog.б", 2), ("config_objects", 1, "catalog.нет", 0), ("config_objects", 2, "catalog.а", 1), ("q", 8, "catalog.в", 0), ("q", 9, "catalog.б", 2)]
    assert references.orphans(refs.limit(0), alive, records).count() == 0 and references.orphans(refs, alive, records.limit(0)).count() == 2
    assert references.orphans(refs, alive.limit(0)).count() == 6
    # a key that nearly all refer to is spread over tasks
    many = refs.where("rec_id = 8").crossJoin(spark.range(500).withColumnRenamed("id", "n")).selectExpr("src", "rec_id + n AS rec_id", "ref", "ts")
    assert references.hot_keys(many).first().parts > 1 and references.orphans(many.unionByName(refs), alive, records).count() == 505


def test_p2_another_time_is_no_orphan(spark):
    """A reference made while its object lives stays clean, though an older one to the same object was an orphan."""
    t = dt.datetime
    objects = spark.createDataFrame(
        [(1, "a", "Catalog", "А", t(2024, 1, 1), None, t(2024, 1, 2)), (2, "b", "Catalog", "Б", t(2024, 1, 1), None, t(2024, 3, 1)), (3, "x", "Catalog", "Х", t(2024, 2, 1), None, t(2024, 2, 1)), (4, "a", "Catalog", "А", t(2024, 1, 1), None, t(2024, 3, 5))],
        "obj_id long, uuid string, object_type string, object_name string, created_at timestamp, deleted_at timestamp, loaded_at timestamp",
    )
    refs = spark.createDataFrame(
        [("config_objects", 1, "catalog.х", t(2024, 1, 2)), ("config_objects", 2, "catalog.х", t(2024, 3, 1)), ("q", 5, "catalog.б", t(2024, 3, 2)), ("q", 6, "catalog.а", t(2024, 3, 2)), ("q", 7, "catalog.а", t(2024, 3, 6))],
        "src string, rec_id long, ref string, ts timestamp",
    )
    got = tuples(references.orphans(refs, references.lives(objects), references.deliveries(objects)), "src", "rec_id", "depth")
    assert got == [("config_objects", 1, 0), ("q", 6, 1)]  # the delivery of А in force on 6 March holds no orphan


def test_p2_long_chain(spark):
    """Every step of a chain of 60 records is reached."""
    t = dt.datetime(2024, 1, 1)
    objects = spark.createDataFrame([(i, f"u{i}", "Catalog", f"О{i}", t, None, t) for i in range(60)], "obj_id long, uuid string, object_type string, object_name string, created_at timestamp, deleted_at timestamp, loaded_at timestamp")
    refs = spark.createDataFrame([("config_objects", i, f"catalog.о{i - 1}" if i else "catalog.нет", t) for i in range(60)], "src string, rec_id long, ref string, ts timestamp")
    assert tuples(references.orphans(refs, references.lives(objects), references.deliveries(objects)), "rec_id", "depth") == [(i, i) for i in range(60)]


def split_packed(text):
    text = re.sub(r"\s*\.\s*$", "", text)
    marks, out, i, n = {'"': '"', "'": "'", "“": "”", "«": "»", "„": "“", "`": "`"}, [], 0, len(text)
    at_end = lambda j: re.match(r"\s*(?:[,;|/+\n\t]|(?:и|или|and|or)\s|\]|$)", text[j:], re.I)
    while i < n:
        m = re.match(r"\s(?:и|или|and|or)\s|[\s,;|/+\[]|\](?=\s*(?:[,;|/+]|$))", text[i:], re.I)
        if m:
            i += m.end()
            continue
        j, value = i, None
        if text[i] in marks:
            close, j, buf = marks[text[i]], i + 1, []
            while j < n:
                if text[j] == "\\" and j + 1 < n:
                    buf.append(text[j + 1] if text[j + 1] in "\"'`“”«»\\" else text[j : j + 2])
                    j += 2
                elif text[j] == close and text[j + 1 : j + 2] == close and close == text[i]:
                    buf.append(close)
                    j += 2
                elif text[j] == close:
                    value = "".join(buf) if at_end(j + 1) else None
                    j += 1
                    break
                else:
                    buf.append(text[j])
                    j += 1
        if value is None:
            j = i
            while j < n:
                p = re.match(r"\([^()]*(?:\([^()]*\)[^()]*)*\)", text[j:])
                if p:
                    j += p.end()
                elif re.match(r"[,;|/+\n\t]|\s(?:и|или|and|or|&)\s|\]\s*(?:[,;|/+\n\t]|$)", text[j:], re.I):
                    break
                else:
                    j += 1
            value = text[i:j]
        value = " ".join(value.split()).lower()
        if value:
            out.append(value)
        i = max(j, i + 1)
    return out


def test_p3(spark, data):
    want = {("methods", r["id"], k, v) for r in rows(data, "methods") for k, v in enumerate(split_packed(r["availability"] or ""), 1)}
    want |= {("context_violations", r["violation_id"], k, v) for r in rows(data, "context_violations") for k, v in enumerate(split_packed(r["available_in"] or ""), 1)}
    assert tuples(g.p3_found(spark, data), "src", "rec_id", "pos", "item") == sorted(want)


def test_p3_cases(spark):
    cases = {
        None: [], "": [], " , ;": [], "Сервер.": ["сервер"], "a, b и c": ["a", "b", "c"], '"a; b", c': ["a; b", "c"], '"a ""q"" b"|c': ['a "q" b', "c"],
        '["x \\"y\\"", "z"]': ['x "y"', "z"], "приложение (клиент, сервер), веб": ["приложение (клиент, сервер)", "веб"], '"open, b': ['"open', "b"],
        "(open, b": ["(open", "b"], "a\n\nb\t c": ["a", "b", "c"], "и": ["и"], '"a" b, c': ['"a" b', "c"], "«а|б»; в": ["а|б", "в"],
    }
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(cases)], "k long, text string, note string")
    got = defaultdict(list)
    for r in sorted(packed.packed_values(df, "text", "k").collect(), key=lambda r: r.pos):
        got[r.k].append(r.item)
    assert [got[i] for i in range(len(cases))] == list(cases.values())
    flags = {r.item: r.error for r in packed.packed_values(df, "text", "k").collect() if r.error}
    assert flags == {'"open': "malformed_quote", "(open": "unbalanced_parenthesis", '"a" b': "malformed_quote"}
    long = spark.createDataFrame([(1, "слово, " * 60_000), (2, '"' + "я" * 300_000), (3, "(" * 50_000)], "k long, text string")
    assert {r.k: r["count"] for r in packed.packed_values(long, "text", "k").groupBy("k").count().collect()} == {1: 60_000, 2: 1, 3: 1}


def test_p3_nested(spark):
    deep = lambda n: "сервер " + "(а, " * n + "б" + ", в)" * n
    cases = {
        "Сервер (а (б (в, г), д), е), Клиент": ["сервер (а (б (в, г), д), е)", "клиент"],
        "тонкий [х, у] клиент, веб": ["тонкий [х, у] клиент", "веб"],
        '[толстый [а [б, в], г] клиент], ["x, y", z]': ["толстый [а [б, в], г] клиент", "x, y", "z"],
        deep(5) + ", клиент": [deep(5), "клиент"],
        deep(9) + ", клиент": [deep(9), "клиент"],
        deep(400) + "; \"кл\"\"иент\"": [deep(400), 'кл"иент'],
        "((((((((а, б), в": ["((((((((а, б)", "в"],
    }
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(cases)], "k long, text string, note string")
    got = defaultdict(list)
    for r in sorted(packed.packed_values(df, "text", "k", "note").collect(), key=lambda r: r.pos):
        got[r.k].append(r.item)
    assert [got[i] for i in range(len(cases))] == list(cases.values())


def test_p3_parser_agrees(spark, data):
    """The expression on the JVM and the parser for deep texts give the same for whatever both can read."""
    import random

    rng = random.Random(9)
    texts = sorted({r["availability"] for r in rows(data, "methods") if r["availability"]} | {r["available_in"] for r in rows(data, "context_violations") if r["available_in"]})
    texts += ["".join(rng.choice(["а", "Б ", " и ", ",", ";", "|", '"', '""', "«", "»", "(", ")", "[", "]", "\\", ".", " ", "\n", "'", "or "]) for _ in range(rng.randint(1, 14))) for _ in range(1500)]
    texts = [t for t in texts if t.count("(") + t.count("[") <= packed.LEVELS]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    got = defaultdict(list)
    for r in sorted(packed.packed_values(df, "text", "k").collect(), key=lambda r: r.pos):
        got[r.k].append((r.item, r.error))
    wrong = [(t, got[i], packed.parse(t)) for i, t in enumerate(texts) if got[i] != packed.parse(t)]
    assert not wrong, wrong[:5]


def test_p4(spark, data):
    want = set()
    for r in rows(data, "config_objects"):
        for name, body in elements(load(r["fields"])):
            if name is not None:
                want.add(("config_objects", r["obj_id"], name))
            for a, _ in elements(body.get("attributes")) if isinstance(body, dict) else []:
                if name is not None and a is not None:
                    want.add(("config_objects", r["obj_id"], f"{name}/{a}"))
    for r in rows(data, "cfe_diffs"):
        for o in r["borrowed_objects"] or []:
            want.add(("cfe_diffs", r["diff_id"], o["object_ref"]))
            for c in o["child_objects"] or []:
                want.add(("cfe_diffs", r["diff_id"], f"{o['object_ref']}/{c['name']}"))
                want |= {("cfe_diffs", r["diff_id"], f"{o['object_ref']}/{c['name']}/{a['name']}") for a in c["attributes"] or []}
    assert tuples(g.p4_found(spark, data), "src", "rec_id", "path") == sorted(want)


def test_p4_links(spark, data):
    from ledgerloom.session import table

    flat = nested.flatten_borrowed(table(spark, data, "cfe_diffs"), "diff_id", "borrowed_objects")
    keys = ["rec_id", "object_idx"]
    assert flat["children"].join(flat["objects"], keys, "left_anti").count() == 0
    assert flat["attributes"].join(flat["children"], [*keys, "child_idx"], "left_anti").count() == 0
    own = nested.flatten_fields(table(spark, data, "config_objects"), "obj_id", "fields")
    assert own["attributes"].join(own["fields"], ["rec_id", "field_idx"], "left_anti").count() == 0 and own["attributes"].count() > 0
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "null"), (4, "[]"), (5, "{}"), (6, "[1, null, [2]]"), (7, '"["'), (8, '{"A": []}'), (9, '[{"name": "x", "attributes": [{"name": "y"}, {}]}]')], "k long, t string")
    assert tuples(nested.field_paths(odd, "k", "t"), "rec_id", "path") == [(9, "x"), (9, "x/y")]


def test_p6(spark, data):
    cols = [*g.METHOD_TEXTS, "params_json", "see_also_json"]

    def norm(c, x):
        if c.endswith("json"):
            try:
                return json.dumps(json.loads(x), sort_keys=True)
            except (TypeError, ValueError):
                pass
        return " ".join((x or "").split())

    latest = {}
    for r in rows(data, "methods"):
        k = (r["version"] or "").strip(), r["source_file"]
        if k not in latest or (r["loaded_at"], r["id"]) > (latest[k]["loaded_at"], latest[k]["id"]):
            latest[k] = r
    by = defaultdict(dict)
    for (v, k), r in latest.items():
        if v and k is not None:
            by[v][k] = [norm(c, r[c]) for c in cols]
    names = sorted(by, key=lambda v: [int(x) for x in v.split(".")])
    want = set()
    for a, b in zip(names, names[1:]):
        for k in by[a].keys() | by[b].keys():
            x, y = by[a].get(k), by[b].get(k)
            if x != y:
                want.add((a, b, k, "added" if x is None else "removed" if y is None else "changed"))
    assert tuples(g.p6_found(spark, data), "version_from", "version_to", "source_file", "change") == sorted(want)


def test_p6_cases(spark):
    mk = lambda *r: spark.createDataFrame(list(r), "id long, v string, k string, t string, j string, version_from int")
    run = lambda df: tuples(snapshots.snapshot_changes(df, "v", "k", ("id",), ("t",), ("j",)), "version_from", "version_to", "k", "change")
    one = mk((1, "1.2", "a", None, '{"x":1,"y":2}', 0), (2, "1.10 ", "a", "", '{"y": 2, "x": 1}', 0), (3, "1.10", "b", "q", None, 0), (4, "1.2", "b", " q  q", None, 0), (5, "1.10", "b", "q q", "", 0), (6, None, "z", "", "", 0), (7, "1.2", None, "", "", 0), (8, "2", "a", "new", "{bad", 0))
    assert run(one) == [("1.10", "2", "a", "changed"), ("1.10", "2", "b", "removed")]
    assert run(one.limit(0)) == [] and run(one.where("id = 1")) == []


def test_p6_chunks(spark):
    """Repeats, gaps between versions and many keys, against brute force; few changed rows leave few chunks to look into."""
    import random

    rng = random.Random(4)
    state, all_rows, want, n = {f"k{i}": 0 for i in range(3000)}, [], set(), 0
    before = None
    for v in range(4):
        for k in rng.sample(sorted(state), 20):
            if rng.random() < 0.5:
                state.pop(k)
            else:
                state[k] += 1
        state |= {f"new{v}_{i}": 0 for i in range(10)}
        for k, x in state.items():
            if rng.random() < 0.01:  # an older delivery with another content
                all_rows.append((n, f"1.{v}", k, str(rng.randint(5, 9))))
                n += 1
            all_rows.append((n, f"1.{v}", k, str(x)))
            n += 1
        if before is not None:
            want |= {(f"1.{v - 1}", f"1.{v}", k, "added" if k not in before else "removed" if k not in state else "changed") for k in before.keys() | state.keys() if before.get(k) != state.get(k)}
        before = dict(state)
    rng.shuffle(all_rows)
    df = spark.createDataFrame(all_rows, "id long, v string, k string, t string")
    assert tuples(snapshots.snapshot_changes(df, "v", "k", ("id",), ("t",)), "version_from", "version_to", "k", "change") == sorted(want)
    narrow = df.selectExpr("CAST(substring(v, 3) AS INT) AS v", "k", "CAST(t AS BINARY) AS d").dropDuplicates(["v", "k"])
    need = snapshots.unmatched_chunks(snapshots.chunk_digests(narrow, 8), snapshots.repeating_chunks(narrow, 8), 3)
    assert 0 < need.selectExpr("sum(size(pairs))").first()[0] < 0.75 * 3 * 256


def test_p6_digest_moves_little(spark):
    """An unchanged snapshot moves no row at all; one changed row moves its chunk only."""
    a = spark.range(4000).selectExpr("id", "'1' AS v", "concat('k', id) AS k", "'x' AS t")
    b = a.selectExpr("id + 4000 AS id", "'2' AS v", "k", "if(k = 'k7', 'y', t) AS t")
    narrow = a.unionByName(b).selectExpr("CAST(v AS INT) - 1 AS v", "k", "CAST(t AS BINARY) AS d")
    need = lambda rows: snapshots.unmatched_chunks(snapshots.chunk_digests(rows, 6), snapshots.repeating_chunks(rows, 6), 1).count()
    assert need(narrow.where("k <> 'k7'")) == 0 and need(narrow) == 1
    assert need(narrow.where("k <> 'k7'").unionByName(narrow.where("k = 'k9'"))) == 1  # a key delivered again is looked into
    assert tuples(snapshots.snapshot_changes(a.unionByName(b), "v", "k", ("id",), ("t",)), "k", "change") == [("k7", "changed")]
