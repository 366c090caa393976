import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from waymark import catalog_io
from waymark.operators import filters, resolve, search, spatial, sync
from waymark.plans import gazetteer as g
from waymark.plans import index as index_plan
from waymark.sources import download, opendata, register, sinks
from waymark.streaming import refresh

OBJECTS = "code bigint, typ int, name string, super_code bigint, zip_code string, lat decimal(10,3), long decimal(10,3), atvk string"


def place(code, typ, name, up=None, zip_code=None, lat=None, long=None, atvk=None):
    return (code, typ, name, up, zip_code, lat and Decimal(lat), long and Decimal(long), atvk)


@pytest.fixture(scope="module")
def objects(spark):
    rows = [
        place(1, g.NOV, "Aknīstes nov.", atvk="N1"), place(2, g.PAG, "Asares pag.", 1, atvk="P1"), place(3, g.CIE, "Ancene", 2), place(4, g.NLT, "Ancīši", 3, "LV-5212", "210000.5", "600000"),
        place(5, g.PIL, "Rīga", atvk="R1"), place(6, g.IEL, "Vīlandes iela", 5), place(7, g.NLT, "18", 6, "LV-1010", "313000", "505000"), place(8, g.DZI, "1", 7), place(9, g.DZI, "2", 7),
        place(10, g.IEL, "Brīvības iela", 5), place(11, g.NLT, "18", 10, "LV-1011", "313100", "505100"), place(12, g.CIE, "Asare", 2),
    ]
    return spark.createDataFrame(rows, OBJECTS).cache()


@pytest.fixture(scope="module")
def history(spark):
    return spark.createDataFrame([(6, 0, "Kirova iela, Rīga"), (6, 1, "Vilandes iela"), (12, 0, "Asares ciems")], "code bigint, pos int, text string")


@pytest.fixture(scope="module")
def paths(objects):
    return g.with_paths(g.with_leaf_flag(objects)).cache()


@pytest.fixture(scope="module")
def index(paths, history):
    return search.Index.build(g.index_strings(paths, history))


def test_paths_and_leaves(paths):
    rows = {r["code"]: r for r in paths.collect()}
    assert [o["code"] for o in rows[8]["path"]] == [8, 7, 6, 5]
    assert {c for c, r in rows.items() if r["is_leaf"]} == {4, 8, 9, 11, 12}


def test_cycles_end(spark):
    rows = g.with_paths(spark.createDataFrame([place(1, g.PIL, "a", 2), place(2, g.PIL, "b", 1)], OBJECTS)).collect()
    assert all(len(r["path"]) == g.MAX_DEPTH for r in rows)


def test_clashing_codes_multiply_no_rows(spark):
    # Code 1 is a municipality's and a flat's; nothing stands below a flat.
    rows = [place(1, g.NOV, "top"), place(2, g.PAG, "mid", 1), place(3, g.NLT, "low", 2), place(1, g.DZI, "flat", 3), place(4, g.DZI, "own", 3)]
    for most in (100_000, 0):
        got = sorted((r["code"], r["typ"], [o["name"] for o in r["path"]]) for r in g.with_paths(spark.createDataFrame(rows, OBJECTS), most).collect())
        assert got == [(1, g.DZI, ["flat", "low", "mid", "top"]), (1, g.NOV, ["top"]), (2, g.PAG, ["mid", "top"]), (3, g.NLT, ["low", "mid", "top"]), (4, g.DZI, ["own", "low", "mid", "top"])]


def test_rows_without_a_parent_do_not_go_up(spark):
    # A thousand buildings that stand alone, each with a flat: no join sees a null parent of theirs.
    rows = [place(i, g.NLT, f"h{i}") for i in range(1000)] + [place(1000 + i, g.DZI, f"f{i}", i) for i in range(1000)]
    paths = g.with_paths(spark.createDataFrame(rows, OBJECTS), 0)
    assert paths._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin") <= 2  # one join a level, of which there is one
    assert {r["code"]: [o["code"] for o in r["path"]] for r in paths.collect()} == {i: [i] for i in range(1000)} | {1000 + i: [1000 + i, i] for i in range(1000)}


def test_address_record(paths, history):
    rows = {r["code"]: r for r in g.address(paths, history=history).collect()}
    assert rows[4]["address"] == "Ancīši\nAncene\nAsares pag.\nAknīstes nov." and rows[8]["address"] == "Vīlandes iela 18 - 1\nRīga"
    assert (rows[8]["zipCode"], rows[8]["lksLat"], rows[8]["ielName"], rows[8]["pilAtvk"], rows[8]["pagCode"]) == ("LV-1010", Decimal("313000.000"), "Vīlandes iela", "R1", None)
    assert rows[6]["history"] == ["Kirova iela, Rīga", "Vilandes iela"] and rows[8]["history"] == []
    assert "lksLat" not in g.address(paths, ()).columns


def test_index_order(paths, history):
    rows = g.index_strings(paths, history).orderBy("idx").collect()
    assert [r["idx"] for r in rows] == list(range(15))
    assert rows[0]["text"] == "Rīga" and rows[1]["text"] == "Aknīstes nov."
    same = [r["text"] for r in rows if r["code"] == 6]
    assert same == ["Rīga Vīlandes iela", "Kirova iela, Rīga", "Vilandes iela"]


def test_an_object_is_dealt_once_with_all_its_texts(spark, paths, history, monkeypatch):
    dealt, own = [], type(paths).repartitionByRange

    def seen(rows, *order):
        dealt.append((rows.count(), sorted(rows.columns)))
        return own(rows, *order)

    monkeypatch.setattr(type(paths), "repartitionByRange", seen)
    rows = g.index_strings(paths, history).collect()
    assert dealt == [(paths.count(), ["code", "name", "past", "w"])]
    assert len(rows) > paths.count() and sorted(r["idx"] for r in rows) == list(range(len(rows)))


def test_numbers_go_on_from_part_to_part(spark):
    rng = random.Random(3)
    given = [(i, rng.randint(0, 9), [f"{i}.{k}" for k in range(rng.randint(0, 3))]) for i in range(500)]
    rows = spark.createDataFrame(given, "code bigint, w int, texts array<string>")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = g.number(rows, {"w": F.col("w"), "minus": -F.col("code")}, "idx", out=[F.col("code"), F.explode("texts").alias("text")])
        assert out.columns == ["code", "text", "idx"] and len(out.inputFiles()) > 1
        got = [(r["text"], r["code"]) for r in out.orderBy("idx").collect()]
        assert out.agg(F.min("idx"), F.max("idx")).first() == (0, len(got) - 1)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert got == [(t, i) for i, w, texts in sorted(given, key=lambda x: (x[1], -x[0])) for t in texts]


def ask(spark, index, paths, history, text, allowed=None, limit=20):
    asked = spark.createDataFrame([(0, text)], "q_id bigint, text string")
    found = search.search(asked, index, search.ranking_words(paths, history), allowed, limit)
    return [(r["code"], r["edit_distance"]) for r in found.orderBy("place").collect()]


def test_search_ranks_and_filters(spark, index, paths, history):
    assert ask(spark, index, paths, history, "vilandes iela 18 1 riga")[0] == (8, 0)
    assert ask(spark, index, paths, history, "kirova")[0] == (6, 0)
    assert {c for c, _ in ask(spark, index, paths, history, "18 riga", filters.of_types(paths, [g.NLT]))} == {7, 11}
    assert {c for c, _ in ask(spark, index, paths, history, "vilandes", filters.postal_objects(paths))} == {8, 9}
    assert ask(spark, index, paths, history, "vilandez iela 18 1")[0] == (8, 1)
    assert len(ask(spark, index, paths, history, "riga", limit=3)) == 3


def test_resolve(spark, index, paths, history):
    records = g.address(paths, ()).select("code", "address")
    asked = spark.createDataFrame([(1, "Ancīši, Ancene, Asares pag., Aknīstes nov."), (2, "Vīlandes iela 18 - 1, Rīga"), (3, "qqqq, Rīga"), (4, "zzzz")], "q_id bigint, text string")
    rows = {r["q_id"]: r["code"] for r in resolve.resolve(asked, index, search.ranking_words(paths, history), records).collect()}
    assert rows == {1: 4, 2: 8, 3: 5, 4: None}


def test_resolve_asks_a_text_once(spark, index, paths, history, monkeypatch):
    steps, own = [], resolve.search

    def counted(asked, *rest, **more):
        steps.append([r["text"] for r in asked.collect()])
        return own(asked, *rest, **more)

    monkeypatch.setattr(resolve, "search", counted)
    records = g.address(paths, ()).select("code", "address")
    texts = ["Vīlandes iela 18 - 1, Rīga", "VĪLANDES iela 18 - 1, Rīga", "qqqq, Rīga", "wwww, Rīga", "qqqq, Rīga", "zzzz", "rīga", None, "zzzz"]
    asked = spark.createDataFrame(list(enumerate(texts)), "q_id bigint, text string")
    rows = {r["q_id"]: (r["text"], r["code"]) for r in resolve.resolve(asked, index, search.ranking_words(paths, history), records).collect()}
    assert rows == {i: (t, c) for i, (t, c) in enumerate(zip(texts, [8, 8, 5, 5, 5, None, 5, None, None], strict=True))}
    # "rīga" was answered and "zzzz" was not by the first step, which the others know; so are whole texts asked again with the part before.
    every = [t for s in steps for t in s if t is not None]
    assert sorted(every) == sorted(set(every)) and {"qqqq, rīga", "rīga", "zzzz"} <= set(every)


def test_only_unanswered_queries_are_spread(spark, index, monkeypatch):
    spread, own = [], search.merge_variants

    def seen(queries):
        spread.extend(r["q_id"] for r in queries.collect())
        return own(queries)

    monkeypatch.setattr(search, "merge_variants", seen)
    asked = spark.createDataFrame([(1, ["vilandes", "iela"]), (2, ["vil", "andes", "ie", "la"]), (3, ["zzzz"]), (4, [])], "q_id bigint, words array<string>")
    found = {(r["q_id"], r["v"], r["edit_distance"]) for r in search.exact_search(asked, index).collect()}
    assert found == {(1, 0, 0), (2, 5, 2)} and spread == [2]
    spread.clear()
    assert search.exact_search(asked.where("q_id in (1, 3)"), index).select("q_id").distinct().count() == 1 and not spread


@pytest.mark.parametrize("unique", [False, True])
def test_nearest_equals_full_scan(spark, unique):
    rng = random.Random(1)
    points = [(i, Decimal(rng.randint(0, 400)), Decimal(rng.randint(0, 400))) for i in range(300)] + [(1000 + i, Decimal(7), Decimal(7)) for i in range(50)] + [(2000, None, Decimal(1))]
    asked = [(i, Decimal(rng.randint(-900, 900)), Decimal(rng.randint(0, 400))) for i in range(40)] + [(50, Decimal(7), Decimal(7)), (51, None, None)]
    df = spatial.nearest(spark.createDataFrame(points, "code bigint, lat decimal(10,3), long decimal(10,3)"), spark.createDataFrame(asked, "q_id bigint, lat decimal(10,3), long decimal(10,3)"), 5, unique)
    got = {}
    for r in df.orderBy("q_id", "place").collect():
        got.setdefault(r["q_id"], []).append((r["distance"], r["code"]))
    for q, x, y in asked:
        if x is None:
            assert q not in got
            continue
        every = sorted(((a - x) ** 2 + (b - y) ** 2, c) for c, a, b in points if a is not None)
        if unique:
            every = list({d: (d, c) for d, c in reversed(every)}.values())[::-1]
        assert got[q] == every[:5]


def test_nearest_few_points(spark):
    none = spark.createDataFrame([], "code bigint, lat decimal(10,3), long decimal(10,3)")
    asked = spark.createDataFrame([(1, Decimal(0), Decimal(0))], "q_id bigint, lat decimal(10,3), long decimal(10,3)")
    assert spatial.nearest(none, asked, 3).count() == 0
    one = spark.createDataFrame([(9, Decimal(5), Decimal(5))], none.schema)
    assert spatial.nearest(one, asked, 3).count() == 1
    with pytest.raises(ValueError):
        spatial.nearest(one, asked, 0)


def test_routes_and_parameters(spark):
    df = spark.createDataFrame([("123456789", 1, 1), ("riga", None, None), ("riga", 200000, 500000), ("riga", 1, 1), ("1234567890", None, 1)], "q string, lat int, long int")
    assert [r[0] for r in df.select(filters.route(F.col("q"), F.col("lat"), F.col("long"))).collect()] == ["code", "text", "nearest", "none", "text"]
    assert filters.parameters()["limit"] == 20 and filters.parameters("500")["limit"] == 100 and filters.parameters("50", lat="1", long="2")["limit"] == 20
    assert filters.parameters(types=["104", " "])["types"] is None and filters.uses_big_index([104, 113]) and not filters.uses_big_index([104, 108])
    for bad in ({"limit": "x"}, {"limit": "-1"}, {"types": ["a"]}, {"types": ["104"], "post_addr": True}):
        with pytest.raises(ValueError):
            filters.parameters(**bad)


def test_sync(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (3, "c", 2)], "k int, v string, tag int")
    new = spark.createDataFrame([(1, "x", 1), (2, "y", 3), (4, "z", 2), (5, "w", 4)], "k int, v string, tag int")
    rows = lambda df: sorted((r["k"], r["v"]) for r in df.collect())
    assert rows(sync.migrate(old, new, "k", "tag")) == [(1, "a"), (2, "y"), (3, "c"), (5, "w")]
    assert sorted(map(tuple, sync.id_diff(old, new, "k").collect())) == [(3, "delete"), (4, "insert"), (5, "insert")]
    assert rows(sync.migrate(old, new, "k")) == [(1, "a"), (2, "b"), (4, "z"), (5, "w")]
    assert rows(sync.migrate(old.limit(0), new, "k", "tag")) == rows(new)
    assert sync.mode(False, "tag", True) == "id_diff"
    fields = [("id", "pk", "ID"), ("on", "yn", "ON_"), ("at", "datetag", "AT")]
    got = sync.renamed(spark.createDataFrame([(7, "Y", "2024-07-01 12:00:00"), (8, "N", "")], "ID int, ON_ string, AT string"), fields).select("id", "on", F.col("at").cast("string")).collect()
    assert [tuple(r) for r in got] == [(7, True, "2024-07-01 09:00:00"), (8, False, None)]
    assert [f.dataType.simpleString() for f in sync.schema(fields)] == ["bigint", "boolean", "timestamp"] and "id bigint not null" in sync.create_table("t", fields)
    with pytest.raises(ValueError):
        sync.convert(F.lit(1), "blob")


def write(path, lines):
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(path)


def line(n, **at):
    row = [""] * n
    for k, v in at.items():
        row[int(k[1:])] = v
    return ",".join(row)


def test_open_data_files(spark, tmp_path):
    city = write(tmp_path / "AW_PILSETA.CSV", [line(13, _0="code"), line(13, _0="5", _1="104", _2='"Rīga, ""R"""', _7="EKS", _12="0001"), line(13, _0="6", _1="104", _2="x", _7="DEL"), line(13, _0="7", _1="999", _2="x", _7="EKS")])
    house = write(tmp_path / "aw_eka.csv", [line(19, _0="h"), line(19, _0="8", _1="108", _7="18", _5="5", _9="LV-1010", _17="313000.5", _18="bad", _2="EKS"), "1,2"])
    again = write(tmp_path / "AW_PILSETA.2.csv", [line(13, _0="h"), line(13, _0="5", _1="104", _2="Rīga", _7="EKS")])
    rows = {r["code"]: r for r in opendata.load_objects(spark, [city, house, again, str(tmp_path / "OTHER.csv")]).collect()}
    assert set(rows) == {5, 8} and rows[5]["name"] == "Rīga" and rows[8]["lat"] == Decimal("313000.500") and rows[8]["long"] is None and rows[8]["zip_code"] == "LV-1010"
    assert opendata.load_objects(spark, [city]).first()["name"] == 'Rīga, "R"'
    past = write(tmp_path / "AW_PILSETA_HIS.csv", [line(6, _0="h"), line(6, _0="5", _5="old", _4="2001.01.01"), line(6, _0="5", _5="newer", _4="2015.05.05"), line(6, _0="5", _5="open", _4="x")])
    got = sorted((r["pos"], r["text"]) for r in opendata.load_history(spark, [past], "2010-01-01").collect())
    assert got == [(0, "open"), (1, "newer")]
    assert opendata.load_history(spark, [past]).count() == 3 and opendata.load_objects(spark, []).count() == 0


def test_short_lines_go_and_the_last_line_of_a_code_stays(spark, tmp_path):
    rows = [line(13, _0="h"), line(13, _0="5", _1="104", _2="first", _7="EKS"), line(13, _0="5", _1="104", _2='"last, one"', _7="EKS"), "6,104,short,,,,,EKS", '6,104,"a,b,c,d,e,f",,,,,EKS']
    got = opendata.load_objects(spark, [write(tmp_path / "AW_PILSETA.csv", rows)]).collect()
    assert [(r["code"], r["name"]) for r in got] == [(5, "last, one")]


def test_archive_keeps_its_letters(spark, tmp_path):
    import zipfile

    row = ";".join(["#5#", "#104#", "#Ķegums#", "", "", "", "", "#EKS#"] + [""] * 5)
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("AW_PILSETA.CSV", f"h\n{row}\n".encode("cp1257"))
    (name,) = opendata.extract_zip(spark, str(tmp_path / "a.zip"), str(tmp_path / "out"), "cp1257")
    (got,) = opendata.load_archive(spark, {"AW_PILSETA": f"{tmp_path}/out/name={name}"}, decoded=True).collect()
    assert (got["code"], got["name"]) == (5, "Ķegums")


def test_saved_index_answers_alike(spark, index, paths, history, tmp_path):
    index.save(str(tmp_path / "saved"), "1")
    again = search.Index.load(spark, str(tmp_path / "saved"))
    assert ask(spark, again, paths, history, "brivibas iela 18") == ask(spark, index, paths, history, "brivibas iela 18")


def test_number_counts_in_order(spark):
    rows = spark.range(500).selectExpr("(id * 7919) % 500 AS a", "id % 3 AS b").repartition(7)
    assert all(r["i"] == r["a"] for r in g.number(rows, ["a", "b"], "i").collect())


def test_register_has_a_remote_name_for_each_table():
    assert register.REMOTE == {t: f"AK.{t.upper()}" for t in register.TABLES}


def test_archive_database_and_synonyms(spark, tmp_path):
    f = tmp_path / "pil.csv"
    f.write_bytes(("\n".join(["h", ";".join(["#5#", "#104#", "#Rīga#", "", "", "", "", "#EKS#"] + [""] * 4 + ["#1#"])]) + "\n").encode("cp1257"))
    at = tmp_path / "xy.csv"
    at.write_bytes(b"code;lat;long\n5;1.5;2.5\n")
    row = opendata.load_archive(spark, {"AW_PILSETA": str(f)}, str(at)).first()
    assert (row["code"], row["name"], row["lat"], row["long"], row["atvk"]) == (5, "Rīga", Decimal("1.500"), Decimal("2.500"), "1")
    t = spark.createDataFrame([(1, 108, 2, "18", "LV-1", "EKS"), (2, 104, None, "R", "A1", "EKS"), (3, 108, 2, "x", "", "DEL")], "kods int, tips_cd int, vkur_cd int, nosaukums string, atrib string, statuss string")
    xy = spark.createDataFrame([(1, 5.0, 6.0)], "vieta_cd int, koord_x double, koord_y double")
    rows = {r["code"]: r for r in opendata.database_objects([t], xy).collect()}
    assert set(rows) == {1, 2} and rows[1]["zip_code"] == "LV-1" and rows[2]["atvk"] == "A1" and rows[1]["lat"] == Decimal(6) and rows[2]["lat"] is None
    s = write(tmp_path / "syn.properties", ["# c", "daugavpils=dpils", "bulvāris=iela"])
    assert sorted(map(tuple, opendata.synonyms(spark, s).collect())) == [("bulvaris", "iela"), ("daugavpils", "dpils")]


def test_zip_entries(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("AW_PILSETA.CSV", "h\n1\n")
        z.writestr("d/AW_IELA.CSV", "h\n2\n")
    assert sorted(opendata.extract_zip(spark, str(tmp_path / "a.zip"), str(tmp_path / "out"))) == ["AW_IELA.CSV", "AW_PILSETA.CSV"]


def test_sinks_and_refresh(spark, paths, tmp_path):
    a = g.address(paths, ("lks_koord",))
    lines = {r["value"] for r in sinks.csv_lines(a, [g.DZI, g.NOV]).collect()}
    assert lines == {"8;Vīlandes iela 18 - 1, Rīga;109;LV-1010;313000.000;505000.000", "9;Vīlandes iela 18 - 2, Rīga;109;LV-1010;313000.000;505000.000", "1;Aknīstes nov.;113;null;null;null"}
    got = a.where("code = 1").withColumn("editDistance", F.lit(0)).select(sinks.json_result(["code", "address", "zipCode", "editDistance"])).first()[0]
    assert got == '{"code":1,"address":"Aknīstes nov."}'
    versions, root = tmp_path / "versions", str(tmp_path / "snap")
    versions.mkdir()
    seen = []

    def run():
        refresh.watch(spark, str(versions), root, lambda v: {"records": a.withColumn("v", F.lit(v))} if v != "30" else 1 / 0, str(tmp_path / "check"), seen.append).awaitTermination()

    write(versions / "a.txt", ["10", "20"])
    run()
    write(versions / "b.txt", ["15"])
    run()
    assert seen == ["20"] and sinks.current_version(spark, root) == "20"
    assert sinks.load_snapshot(spark, root, ["records"])["records"].first()["v"] == "20"
    write(versions / "c.txt", ["30"])
    with pytest.raises(Exception):
        run()
    assert sinks.current_version(spark, root) == "20" and sinks.old_versions(["3", "1", "2"]) == ["1", "2"]
    with pytest.raises(ValueError):
        sinks.load_snapshot(spark, str(tmp_path / "none"), ["x"])


def test_replicated_tables(spark):
    assert list(register.TABLES) == ["arg_adrese", "arg_adrese_arh", "art_vieta", "art_nlieta", "art_eka_geo", "art_dziv"]
    assert register.key("art_eka_geo") == "mslink" and register.mark("art_eka_geo") is None and register.mark("art_dziv") == "dat_mod"
    assert len(register.fields("arg_adrese")) == 16 and len(register.fields("art_nlieta")) == 15
    source = spark.createDataFrame([(1, 10, 1.5, 2.5), (2, 20, 3.0, 4.0)], "mslink int, vieta_cd int, koord_x double, koord_y double")
    target = sync.renamed(source.limit(1), register.fields("art_eka_geo"))
    out = {}
    register.replicate(["art_eka_geo"], lambda t: source, lambda t: target, out.__setitem__)
    assert sorted(r["mslink"] for r in out["art_eka_geo"].collect()) == [1, 2]
    assert register.arguments(["--verify", "art_dziv"]).tables == ["art_dziv"] and register.arguments([]).tables == list(register.TABLES)
    with pytest.raises(SystemExit):
        register.arguments(["none"])


def test_download(tmp_path):
    import http.server
    import threading

    class Handler(http.server.BaseHTTPRequestHandler):
        def answer(self):
            self.send_response(200)
            self.send_header("Last-Modified", "Tue, 02 Jan 2024 03:04:05 GMT")
            self.end_headers()

        do_HEAD = answer

        def do_GET(self):
            self.answer()
            self.wfile.write(b"content")

        def log_message(self, *_):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/aw_eka.csv"
    got = download.fetch(url, str(tmp_path))
    assert got.endswith("2024_01_02T03_04_05.aw_eka.csv") and open(got).read() == "content"
    assert download.fetch(url, str(tmp_path)) is None
    (tmp_path / "2023_01_02T03_04_05.aw_eka.csv").write_text("old")
    assert download.current_files(str(tmp_path), [url]) == {"aw_eka.csv": got} and download.version(str(tmp_path), [url]) == "2024_01_02T03_04_05"
    assert opendata.kind_of(got) == "AW_EKA"
    assert download.drop_old(str(tmp_path), download.STAMP + r"\.aw_eka\.csv") == ["2023_01_02T03_04_05.aw_eka.csv"]
    server.shutdown()


def test_kinds_with_one_code_are_all_loaded(spark, sf_dir, tmp_path):
    # A flat whose key has more than six digits gets the code of a municipality.
    for t in ("region", "nation", "supplier", "customer"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").write.parquet(str(tmp_path / f"{t}.parquet"))
    spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("o_orderkey", F.col("o_orderkey") + 4_000_000).write.parquet(str(tmp_path / "orders.parquet"))
    got = catalog_io.open_data_objects(spark, str(tmp_path))
    gaz = g.synthetic(spark, str(tmp_path)).where("code % 10 <> 3").select("code", "typ", "name")
    assert sorted(map(tuple, got.select("code", "typ", "name").collect())) == sorted(map(tuple, gaz.collect()))
    assert got.where("code = 113000000").count() == 2


def test_written_lines_keep_their_order_over_files(spark, tmp_path):
    rows = spark.range(2000).select(F.col("id"), (F.col("id") % 3).alias("code"), F.concat(F.lit("n"), "id").alias("text"), F.lit("2001.01.01").alias("end_date"))
    at = opendata.HISTORY_FILES["AW_EKA_HIS"]
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        file = catalog_io._write(rows.orderBy(F.desc("id")), {at[c]: F.col(c) for c in at}, ["id"], str(tmp_path / "AW_EKA_HIS"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert len(list((tmp_path / "AW_EKA_HIS").glob("part-*.csv"))) > 1
    got = {(r["code"], r["pos"]): r["text"] for r in opendata.load_history(spark, [file]).collect()}
    assert len(got) == 2000 and all(got[c, p] == f"n{[i for i in range(2000) if i % 3 == c][::-1][p]}" for c, p in ((0, 0), (1, 5), (2, 300), (0, 666)))


def both_ways(spark, rows, texts):
    """q_id, code by groups of alike objects, and by an index of every object."""
    paths = g.with_paths(spark.createDataFrame(rows, OBJECTS)).cache()
    asked = spark.createDataFrame(list(enumerate(texts)), "q_id bigint, text string")
    alike = resolve.Alike.build(paths.select("code", "typ", g.named_path(F.col("path")).alias("path")))
    every = resolve.resolve(asked, search.Index.build(g.index_strings(paths)), search.ranking_words(paths), g.address(g.with_leaf_flag(paths), ()).select("code", "address"))
    return [{r["q_id"]: (r["text"], r["code"], r["address"]) for r in found.collect()} for found in (resolve.resolve_alike(asked, alike), every)]


def test_alike_objects_answer_as_every_object(spark):
    rows = [place(1, g.PIL, "Rīga"), place(2, g.PIL, "Riga"), place(3, g.PIL, "RĪGA"), place(4, g.PIL, "Rīga"), place(5, g.PIL, "Riga")]
    rows += [place(10 + i, g.IEL, "Vīlandes iela", 1 + i % 5) for i in range(15)]
    rows += [place(100 + i, g.NLT, str(1 + i % 3), 10 + i % 15) for i in range(60)]
    rows += [place(1000 + i, g.DZI, "1", 100 + i % 60) for i in range(80)] + [place(2000, g.DZI, "2", 100)]
    texts = ["Rīga", "Riga", "RĪGA", "riga", "Vīlandes iela, Rīga", "Vilandes iela, Riga", "Vīlandes iela 1, Rīga", "Vīlandes iela 2 - 1, Rīga", "Vīlandes iela 1 - 2, Rīga", "Vīlandez iela 3, RĪGA", "qqqq, Riga", "Vil andes iela 1, Rīga", "1", "iela", "zzzz", "", None, "1, Rīga"]
    alike, every = both_ways(spark, rows, texts)
    assert alike == every and alike[0][1] == 1 and alike[7][1] is not None and alike[14][1] is None


@pytest.mark.parametrize("copies", [1000, 1030])
def test_alike_objects_count_one_by_one(spark, copies):
    # The village ranks best, but stands behind the cities, of which a search considers 1024.
    rows = [place(i, g.PIL, "Alfa Beta") for i in range(copies)] + [place(9000, g.CIE, "Beta Alfa"), place(9001, g.CIE, "Beta Alfa"), place(9002, g.CIE, "Gamma")]
    alike, every = both_ways(spark, rows, ["Beta Alfa", "Alfa Beta", "Gamma"])
    assert alike == every and alike[0][1] == (9000 if copies < search.MAX_REFS else None) and alike[2][1] == 9002


def test_alike_objects_may_share_codes(spark):
    rows = [(1, g.NLT, [(g.NLT, "18"), (g.PIL, "Rīga")]), (1, g.DZI, [(g.DZI, "2"), (g.NLT, "19"), (g.PIL, "Rīga")]), (2, g.DZI, [(g.DZI, "2"), (g.NLT, "18"), (g.PIL, "Rīga")]), (3, g.NLT, [(g.NLT, "19"), (g.PIL, "Rīga")])]
    objects = spark.createDataFrame(rows, "code bigint, typ int, path array<struct<typ:int,name:string>>")
    asked = spark.createDataFrame([(1, "18, Rīga"), (1, "19 - 2, Rīga"), (2, "18 - 2, Rīga"), (3, "19, Rīga"), (4, "18 - 3, Rīga")], "q_id bigint, text string")
    got = sorted((r["q_id"], r["text"], r["code"], r["address"]) for r in resolve.resolve_alike(asked, resolve.Alike.build(objects)).collect())
    # The last one's end "Rīga" is asked, which no object is.
    assert got[:4] == [(1, "18, Rīga", 1, "18\nRīga"), (1, "19 - 2, Rīga", 1, "19 - 2\nRīga"), (2, "18 - 2, Rīga", 2, "18 - 2\nRīga"), (3, "19, Rīga", 3, "19\nRīga")] and len(got) == 5


def test_copies_do_not_grow_the_index(spark, sf_dir, tmp_path, monkeypatch):
    from waymark import catalog

    for t in ("region", "nation", "supplier", "customer", "orders"):
        keys = {"supplier": ["s_suppkey"], "customer": ["c_custkey"], "orders": ["o_orderkey", "o_custkey"]}.get(t, [])
        rows = spark.read.parquet(f"{sf_dir}/{t}.parquet")
        for i in range(1, 3 if keys else 1):
            rows = rows.unionByName(spark.read.parquet(f"{sf_dir}/{t}.parquet").withColumns({k: F.col(k) + 100_000 * i for k in keys}))
        rows.write.parquet(f"{tmp_path}/{t}.parquet")
    sizes = []
    for kind in (search.Index, search.AskedIndex):
        own = kind.build.__func__
        monkeypatch.setattr(kind, "build", classmethod(lambda cls, strings, *more, own=own: sizes.append(strings.count()) or own(cls, strings, *more)))
    found = [{(r["text"], r["code"], r["address"]) for r in catalog.resolve_batch(spark, str(d)).collect()} for d in (sf_dir, tmp_path)]
    assert found[0] == found[1] and sizes[0] == sizes[1] and len(sizes) == 2


def test_asked_postings_equal_the_full_ones(spark):
    texts = ["ak ak aka", "aka akācijas", "Rīga riga RIGA", "", None, "a-b, a.b", "21 215 2", "x" * 40, "ak"]
    strings = spark.createDataFrame([(i, 100 + i, t) for i, t in enumerate(texts)], "idx bigint, code bigint, text string")
    full = search.Index.build(strings)
    asked = spark.createDataFrame([(t,) for t in ("ak", "ak", "a", "rig", "riga", "2", "21", "zz", "", "xx")], "token string")
    key = lambda rows: sorted((r["mult"], r["token"], r["idx"], r["exact"]) for r in rows.collect())
    got = key(index_plan.postings_of(strings, asked))
    assert got == key(full.posting.join(asked.distinct(), "token")) and {t for _, t, _, _ in got} == {"ak", "a", "rig", "riga", "2", "21", "xx"}
    queries = spark.createDataFrame([(1, ["ak", "ak"]), (2, ["ri", "ga"]), (3, ["a", "b"]), (4, ["2", "21"]), (5, ["zz"]), (6, ["aka", "a"])], "q_id bigint, words array<string>")
    some = search.AskedIndex.build(strings)
    rows = lambda index: sorted(map(tuple, search.exact_search(queries, index).collect()))
    assert rows(some) == rows(full) and {r[0] for r in rows(some)} == {1, 2, 3, 4, 6}
