"""Reading of trees and archives: what is opened, pieces of large files, deep syntax."""

import json
import os
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from riskweave import cli
from riskweave.operators import pii
from riskweave.operators.python_facts import python_facts
from riskweave.plans import registry, scan
from riskweave.sources import tree


def opened(reader):
    """Paths that the reader's tasks would open."""
    return sorted(row["path"] for part in reader.partitions() for row, _ in part.files)


@pytest.fixture()
def mixed(tmp_path):
    root = tmp_path / "mixed"
    for name in ("a.py", "dist/b.py", "logo.png", "node_modules/x/index.js", "node_modules/x/package.json", "docs/read.md", "dist/read.md", "requirements.txt", ".env", "web/p.tsx", "noext", ".git/c.py"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text("x = 1\n")
    return root


def test_only_wanted_files_are_opened(spark, mixed, monkeypatch):
    with open(mixed / "movie.mp4", "wb") as f:
        f.truncate(1 << 30)  # costs nothing, as nobody reads it
    reader = tree.TreeReader({"path": str(mixed), "wanted": "true"})
    # Files below dist are no code and no text, but dependencies are looked for in all Python files.
    assert opened(reader) == [".env", "a.py", "dist/b.py", "docs/read.md", "node_modules/x/package.json", "requirements.txt", "web/p.tsx"]
    names = []
    monkeypatch.setattr(tree.TreeReader, "open", lambda self, path: names.append(path) or open(os.path.join(self.root, path), "rb"))
    assert len([r for part in reader.partitions() for r in reader.read(part)]) == len(names) == 7
    assert {r["path"] for r in tree.read_tree(spark, str(mixed), wanted=True).select("path").collect()} == set(names)


def test_filters_reach_the_list(spark, mixed):
    before = spark.conf.get("spark.sql.python.filterPushdown.enabled")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        os.mkfifo(mixed / "pipe.py")  # no regular file: not listed
        (mixed / "closed.bin").write_bytes(b"x")
        files = tree.read_files(spark, str(mixed))
        some = files.where(F.col("suffix").isin(".py", ".md") & ~F.col("path").startswith("dist/") & (F.col("bytes") < 100) & F.col("wanted"))
        assert sorted(r["path"] for r in some.select("path").collect()) == ["a.py", "docs/read.md"]
        assert "Filter (" not in some._jdf.queryExecution().executedPlan().toString()
        assert files.where("text = 'x'").count() == 1  # of content, not of the list: Spark's own
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", before)


def test_pushed_tests_say_what_filters_say():
    from pyspark.sql.datasource import EqualTo, In, IsNull, Not, StringEndsWith, StringStartsWith

    row = {"path": "a/b.py", "name": "b.py", "suffix": ".py", "bytes": 3, "wanted": True}
    for f, says in ((EqualTo(("name",), "b.py"), True), (In(("suffix",), (".js",)), False), (Not(StringStartsWith(("path",), "a/")), False), (StringEndsWith(("path",), ".py"), True)):
        assert tree.listed_test(f)(row) is says
    assert tree.listed_test(EqualTo(("text",), "x")) is None and tree.listed_test(IsNull(("name",))) is None and tree.listed_test(Not(EqualTo(("text",), "x"))) is None


def test_a_folder_that_cannot_be_listed_fails(mixed, monkeypatch):
    real = os.scandir

    def scandir(path):
        if str(path).endswith("docs"):
            raise PermissionError(13, "closed", path)
        return real(path)

    monkeypatch.setattr(os, "scandir", scandir)
    with pytest.raises(PermissionError):
        tree.TreeReader({"path": str(mixed)}).partitions()


def test_partitions_follow_sizes(tmp_path, monkeypatch):
    monkeypatch.setattr(tree.TreeReader, "BYTES", 100)
    for n in range(10):
        (tmp_path / f"{n}.py").write_bytes(b"#" * 60)
    (tmp_path / "z.md").write_bytes(b"x\n" * 500)
    parts = tree.TreeReader({"path": str(tmp_path), "split": "400"}).partitions()
    assert [len(p.files) for p in parts if p.files[0][1] is None] == [2] * 5
    assert [p.files[0][1] for p in parts if p.files[0][1] is not None] == [0, 1, 2]


def long_text(rng, lines):
    """Lines of all kinds, phone numbers over line ends, other line ends, bytes that are no UTF-8."""
    some = [
        b"customer_cpf = 1", b"529.982.247-25", b"# sample row", b"x", b"", b"tel 55", b"11 91234-5678", b"(11)", b"91234-5678 55 11 91234-5678", b"mail to a.b@c.org, d@e.com.br",
        b"01310-100", b"11144477735", b"12345678901", b"\xff\xfe 529.982.247-25 \xc3", "número ÉÉ 55".encode(), b"contato: x@y.org", b"1234", b"  ", b"cpf 529.982.247-25)",
    ]
    return b"".join(rng.choice(some) + rng.choice([b"\n", b"\n", b"\n", b"\r\n", b"\r"]) for _ in range(lines))


@pytest.mark.parametrize("split", [40, 333, 5000])
def test_pieces_find_what_the_whole_has(spark, tmp_path, split):
    rng = random.Random(split)
    for n, lines in enumerate((3, 60, 400)):
        (tmp_path / f"{n}.txt").write_bytes(long_text(rng, lines))
    (tmp_path / "digits.txt").write_bytes(b"".join(b"%08d\n" % rng.randrange(10**8) for _ in range(60)))
    (tmp_path / "one.md").write_bytes(b"cpf 529.982.247-25 " * 100)
    (tmp_path / "app.py").write_bytes(b"import httpx\n" + b"# cpf 529.982.247-25\n" * 60 + b"httpx.get('https://h')\n")
    whole, pieces = tree.read_tree(spark, str(tmp_path)), tree.read_pieces(spark, str(tmp_path), split)
    assert pieces.where("pieces > 1 AND piece >= 0").count() > (20 if split == 40 else 0)
    key = lambda rows: sorted(map(str, rows.collect()))
    columns = ["path", "kind", "seq", "line", "snippet", "confidence", "tier", "signals"]
    assert key(pii.scan_pii(pieces).select(*columns)) == key(pii.scan_pii(whole).select(*columns)) != []
    loose = ["path", "kind", "seq", "line", "snippet"]
    assert key(pii.scan_pii(pieces, require_context=False).select(*loose)) == key(pii.scan_pii(whole, require_context=False).select(*loose))
    assert key(python_facts(tree.whole_files(pieces))) == key(python_facts(whole)) != []


def test_cuts_are_where_no_match_is_and_cover_the_file(tmp_path):
    rng = random.Random(5)
    for n in range(20):
        path = tmp_path / f"{n}.txt"
        path.write_bytes(long_text(rng, 80))
        size = path.stat().st_size
        with open(path, "rb") as f:
            for split in (1, 7, 64, size, 3 * size):
                got = [tree.piece_of(f, size, split, k) for k in range(-(-size // split))]
                own = "".join(text[a:b] for a, b, _, _, text in filter(None, got))
                assert own == tree.decoded(path.read_bytes())


def test_an_archive_is_read_without_unpacking(spark, tmp_path, monkeypatch, capsys):
    entries = {"app/agent.py": b"import httpx\nif __name__ == '__main__':\n    httpx.get('https://h')\n", "big.txt": b"customer_cpf 529.982.247-25\n" * 40, "img/logo.png": b"\x89PNG", ".git/x.py": b"x"}
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in entries.items():
            z.writestr(name, data)
            (tmp_path / "plain" / name).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / "plain" / name).write_bytes(data)
    before = sorted(str(p) for p in tmp_path.rglob("*"))
    monkeypatch.setattr(zipfile.ZipFile, "extract", None)
    found = {}
    for source in ("a.zip", "plain"):
        result = scan.scan_directory(spark, str(tmp_path / source), split=200)
        found[source] = [sorted(map(str, x.collect())) for x in (result.facts, result.findings, result.config)], result.files_py
        result.release()
    assert found["a.zip"] == found["plain"] and len(found["a.zip"][0][1]) == 40
    assert opened(tree.ArchiveReader({"path": str(tmp_path / "a.zip"), "wanted": "true"})) == ["app/agent.py", "big.txt"]
    assert cli.main(["check", str(tmp_path / "a.zip"), "--json"]) == 0 and json.loads(capsys.readouterr().out)["pii_findings"] == 40
    assert sorted(str(p) for p in tmp_path.rglob("*")) == before
    for bad in ("../y.py", "/y.py"):
        with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
            z.writestr(bad, "1")
        assert cli.main(["check", str(tmp_path / "b.zip")]) == 2
    (tmp_path / "c.zip").write_bytes(b"no archive")
    assert cli.main(["check", str(tmp_path / "c.zip")]) == 2


def test_archive_limits(tmp_path, monkeypatch):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for n in range(5):
            z.writestr(f"{n}.py", "x" * 100)
    for name, limit in (("MOST_ENTRIES", 4), ("MOST_PLAIN_BYTES", 499), ("MOST_ZIP_BYTES", 10)):
        with monkeypatch.context() as m:
            m.setattr(tree, name, limit)
            with pytest.raises(tree.UnsafeZipError):
                tree.ArchiveReader({"path": str(tmp_path / "a.zip")}).partitions()
    link = zipfile.ZipInfo("link")
    link.external_attr = 0o120777 << 16
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr(link, "/etc/passwd")
    with pytest.raises(tree.UnsafeZipError):
        tree.checked_entries(tmp_path / "b.zip")


DEEP = "import httpx\nhttpx.get('https://h')\ntotal = " + " + ".join(["httpx.get('https://h')"] + ["a"] * 2500) + "\nx = b" + ".filter(1)" * 900 + ".stream()\n"


def test_deep_syntax_gives_all_its_facts(spark):
    rows = spark.createDataFrame([("a.py", DEEP), ("b.py", "def ("), ("c.py", "x = " + "+".join(["a"] * 50_000) + "\nhttpx.get('u')\n")], "path string, text string")
    got = sorted((r["path"], r["fact"], r["kind"] or "") for r in python_facts(tree.named(rows)).collect())
    assert got == [("a.py", "external_call", "GET")] * 2 + [("a.py", "operation", "invoke_llm"), ("c.py", "unread", "")]


def test_a_file_too_deep_to_parse_fails_the_gate(spark, tmp_path, capsys):
    (tmp_path / "deep.py").write_text("x = " + "+".join(["a"] * 50_000))
    with pytest.raises(scan.UnreadFileError):
        scan.scan_directory(spark, str(tmp_path))
    assert cli.main(["check", str(tmp_path)]) == 2 and "deep.py" in capsys.readouterr().err


def test_one_parse_a_file(spark):
    rows = spark.createDataFrame([("a.py", "x")], "path string, text string")
    plan = python_facts(tree.named(rows))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1
    plan = registry.empty_scan(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2
