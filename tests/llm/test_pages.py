"""Pages and archives: odd markup, long pages, repeats, clashing columns."""

import base64
import gzip
import hashlib
import html as H
import random
import re
import time

import pytest

from lociq.llm import html, warc

W = {"|p|": 2.0, "|h1|": 2.0, "|div|": 0.1}


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<div data-x=it's><p>four five six</p></div><p>don't stop now</p><p>end here</p>", "four five six\n\ndon't stop now\n\nend here"),
        ("<p>" + "İ" * 40 + "</p><SCRIPT>x < y</Script ><p>the next paragraph</p>", "İ" * 40 + "\n\nthe next paragraph"),
        ("<p>a < b and c > d</p><p a='x>y' b=\"q>r\">two words</p><!-- <p>no</p> --><p>last", "a < b and c > d\n\ntwo words\n\nlast"),
        ("<p>one</p><div class='ad'>" + "buy now " * 500 + "</div><p>two</p>", "one\n\ntwo"),
        ("<header>site</header><article><header><h1>A title</h1></header><p>body</p></article><aside>x</aside>", "A title\n\nbody"),
        ("<p>kept</p><p unfinished='", "kept"),
        ("", ""),
        ("<nav>only menus here</nav>", ""),
    ],
)
def test_pages(page, text):
    assert html.Page(page).text(W) == text


@pytest.mark.parametrize("page", ["<a " * 300_000, "<b>x" * 200_000, "<p>" + "</i>" * 200_000, "<div>" * 200_000 + "</div>" * 200_000, "<script>" * 100_000, "<p>a" + "<!--" * 200_000, "<a b='" * 100_000])
def test_time_is_linear(page):
    begun = time.time()
    html.Page(page).text(W)
    assert time.time() - begun < 15


def test_region_is_the_best_range():
    rng = random.Random(5)
    for _ in range(200):
        page = html.Page("".join(rng.choice(["<p>a b</p>", "<li>x</li>", "<div>y z w</div>", "<br>", "<h2>t</h2>"]) for _ in range(rng.randrange(1, 12))))
        weights = {f"|{b}|": rng.uniform(-1, 1) for b in ("p", "li", "div", "h2")}
        score = [html.word_weight(weights, i[1]) * i[2] if i[0] == "text" else html.tag_weight(weights, i[1]) for i in page.items]
        lo, hi = page.region(weights)
        best = max([0.0] + [sum(score[a:b]) for a in range(len(score)) for b in range(a + 1, len(score) + 1)])
        assert sum(score[lo:hi]) == pytest.approx(best)


def test_extract_finds_the_articles(spark):
    """The whole path with weights fitted on the pages themselves, against the articles that the pages mark."""
    d = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = d.collect()
    more = spark.createDataFrame([(None, None, None), (10**9, "u", ""), (10**9, "u", "")], d.schema).withColumn("HTML2", html.F.lit("x")).withColumn("text", html.F.lit("no"))
    got = html.extract(d.withColumn("HTML2", html.F.lit("x")).withColumn("text", html.F.lit("no")).unionByName(more)).collect()
    assert len(got) == len(rows) + 3
    by = {(r["page_id"], r["url"]): r for r in got}
    assert by[None, None]["text"] == "" and by[10**9, "u"]["n_chars"] == 0
    for r in rows:
        body = re.sub(r"<!--.*?-->|<script.*?</script>", "", r["html"][r["html"].index("<article>") : r["html"].index("</article>")], flags=re.S)
        blocks = (" ".join(H.unescape(re.sub(r"<[^>]+>", "", x)).split()) for x in re.split(r"</?(?:p|h1|article)[^>]*>", re.sub(r"<br/?>", " ", body)))
        want = "\n\n".join(b for b in blocks if b)
        assert by[r["page_id"], r["url"]]["text"] == want and by[r["page_id"], r["url"]]["n_chars"] == len(want)


def test_archives_hold_one_gzip_member_a_record(spark):
    big = "<p>" + "long " * 400_000
    rows = [(i, f"http://h{i % 3}.example/{i}?q=1#f", f"<p>{i % 5}") for i in range(40)] + [(100, "http://x.example", big), (101, "http://x.example", big), (7, None, None)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3).withColumn("URL2", html.F.lit(1)).withColumn("run", html.F.lit("clash"))
    archives = warc.write_archives(d)
    files = [bytes(r["content"]) for r in archives.collect()]
    assert sum(len(list(warc.parse(f))) for f in files) == len(rows)
    assert sum(gzip.decompress(f).count(b"WARC/1.1\r\n") for f in files) == len(rows)
    got = {(r["page_id"], r["payload_bytes"]): r for r in warc.captures(archives).collect()}
    assert len(got) == len(rows)
    for i, _, h in rows:
        p = (h or "").encode()
        r = got[i, len(p)]
        assert r["payload_digest"] == base64.b32encode(hashlib.sha1(p).digest()).decode()
        top = max(j for j, _, x in rows if (x or "") == (h or ""))
        assert (r["record_type"], r["refers_to"]) == (("response", None) if i == top else ("revisit", top))


def test_blocks_of_a_run_are_opened_in_turn():
    rows = [(r, i, f"k{i:04}", "t", i, "response", 1, "d", None) for r in (3, 9) for i in range(700)]
    blocks = list(warc._packed(iter(rows)))
    assert len(blocks) == 6
    assert [x[2] for x in warc._opened([b for r, b in blocks if r == 3])] == list(range(700))
