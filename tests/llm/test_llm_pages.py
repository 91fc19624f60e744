"""WARC archives and main texts."""

import base64
import gzip
import hashlib

import pytest

from annalist.llm import html_tree, warc
from annalist.llm.common import shared_folder

PAGES = "page_id long, url string, html string, text int, refers_to string"


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(1, "http://a.b/x", "<p>é</p>"), (2, None, None), (3, "http://a.b/ y\r\nz", ""), (4, "u", "<p>é</p>"), (5, "u", "x" * 300_000), (6, "v", "x" * 300_000)]
    rows = [(*r, 7, "clash") for r in rows]
    return spark.createDataFrame(rows + [rows[0], (None, "u", "lost", 0, "")], PAGES), rows


def test_warc_round_trip(spark, pages):
    df, rows = pages
    manifest = warc.write_archives(warc.plan_records(df), shared_folder(spark, "warc"), chunk=1000, archive_bytes=600)
    chunks = warc.read_archives(manifest, chunk=1000)
    found = warc.payloads(chunks).collect()
    assert len(found) == len(rows) + 1  # the repeated row is written twice, the one without an id not at all
    payload = {r[0]: (r[2] or "").encode() for r in rows}
    for r in found:
        data = payload[r["page_id"]]
        first = max(i for i, d in payload.items() if d == data)
        assert r["payload_bytes"] == len(data)
        assert r["payload_digest"] == base64.b32encode(hashlib.sha1(data).digest()).decode()
        assert (r["record_type"], r["refers_to"]) == (("response", None) if first == r["page_id"] else ("revisit", first))
    parts = sorted((r["chunk_no"], bytes(r["data"]), r["digest"]) for r in chunks.where("page_id = 6").collect())
    assert len(parts) == 300 and b"".join(p[1] for p in parts) == payload[6]
    assert parts[1][2] == base64.b32encode(hashlib.sha1(payload[6][:2000]).digest()).decode()
    assert manifest.count() > 1 and manifest.agg({"n_records": "sum"}).first()[0] == len(found)


def test_warc_bytes():
    data = gzip.decompress(b"".join(warc.record_bytes(7, "http://a/ b", b"<p>", None)))
    head, _, rest = data.partition(b"\r\n\r\n")
    assert head.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and b"WARC-Target-URI: http://a/%20b" in head
    assert rest.endswith(b"\r\n\r\n<p>\r\n\r\n") and b"Content-Length: %d" % (len(rest) - 4) in head
    revisit = gzip.decompress(b"".join(warc.record_bytes(8, None, b"<p>", 7)))
    assert b"WARC-Refers-To: <urn:page:7>" in revisit and b"<p>" not in revisit


def test_warc_of_nothing(spark):
    empty = warc.plan_records(spark.createDataFrame([], PAGES))
    assert warc.payloads(warc.read_archives(warc.write_archives(empty, shared_folder(spark, "warc")))).count() == 0


def test_broken_archives(tmp_path):
    whole = b"".join(warc.record_bytes(1, "u", b"y" * 5000, None))
    (tmp_path / "cut.warc.gz").write_bytes(whole[:-30])
    with pytest.raises(ValueError):
        list(warc.chunk_rows(str(tmp_path / "cut.warc.gz"), 512))
    (tmp_path / "other.gz").write_bytes(gzip.compress(b"no record\r\n"))
    with pytest.raises(ValueError):
        list(warc.chunk_rows(str(tmp_path / "other.gz")))


SOURCES = {
    "<p>a &amp; b</p><p> c\n d </p>": "a & b\nc d",
    "<article><h1>T</h1><p><b>one<br>two<p>th<i>r</i>ee</article><footer>f</footer>": "T\none two\nthree",
    "<nav>n</nav><div class='ad banner'>x</div><div>y<ul><li>1<li>2</ul>z</div>": "y\n1\n2\nz",
    "<script>var t='</p>';</script><style>p{}</style><p>k<!-- no --> l": "k l",
    "<main><p>m</p><form><p>q</p></form><aside>s</aside><section id=comments><article>c</article></section></main><p>o</p>": "m",
    "a < b and <c": "a < b and <c",
    "<table><tr><td>1<td>2<tr><td>3</table>": "1\n2\n3",
    "<p>x&nbsp;&#233;&lt;br&gt;</p>": "x é<br>",
    "<div hidden>h</div><div role=navigation>r</div><p style='display: none'>d</p>v": "v",
    "": "", None: "", "<p></p>": "",
}


@pytest.mark.parametrize("source", list(SOURCES), ids=range(len(SOURCES)))
def test_main_text(source):
    assert html_tree.main_text(source) == SOURCES[source]


def test_style_tree_removes_what_repeats(spark):
    box = "<div class='box'><span>Read our terms and call us</span></div>"
    rows = [(i, f"http://Site.example/{i}", f"<body>{box}<div class=body><p>text number {i}</p><p>more {i * i}</p></div></body>") for i in range(9)]
    rows += [(20, "http://small.example/", f"<body>{box}<p>one</p></body>"), (21, None, f"<body>{box}<p>x</p></body>"), (22, "http://site.example/n", None)]
    rows += [rows[0], (23, "no url at all", "<p>free</p>")]
    df = spark.createDataFrame([(*r, 5, "c") for r in rows], "page_id long, url string, html string, text int, _x string")
    found = {r["page_id"]: r for r in html_tree.extract(df).collect()}
    assert found[3]["text"] == "text number 3\nmore 9" and found[3]["n_chars"] == 20
    assert found[20]["text"] == "Read our terms and call us\none"  # too few pages to tell
    assert found[21]["text"] == "Read our terms and call us\nx" and found[22]["text"] == "" and found[22]["n_chars"] == 0
    assert html_tree.extract(df).count() == len(rows)


def test_copies_of_a_page_are_one_page(spark):
    rows = [(i, "http://h.example/", "<body><div><p>same article on every page</p></div></body>") for i in range(12)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r["text"] for r in html_tree.extract(df).collect()} == {"same article on every page"}
    assert html_tree.extract(df.limit(0)).count() == 0


def test_importance_is_entropy(spark):
    rows = [("h", f"<body><div>{'odd' if i % 2 else 'even'}</div><p>{i}</p><b>x</b></body>") for i in range(8)]
    tree = {r["node"]: r for r in html_tree.style_tree(spark.createDataFrame(rows, "host string, html string")).collect()}
    assert tree["/body/p"]["importance"] == pytest.approx(1.0)
    assert tree["/body/div"]["importance"] == pytest.approx(1 - 2 / 3)
    assert tree["/body"]["importance"] == pytest.approx(1.0) and tree["/body"]["pages"] == 8
