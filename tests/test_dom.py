"""Page parsing, block selection, fields and edges."""

import random

import pytest

from webloom.functions import dom as D

BASE = "https://uni.example/a-1.html"


def ex(html, url=BASE, **kw):
    return D.extract(html, url, home="uni.example", **kw)


def para(rng, n=3):
    words = "nhà trường sinh viên học kỳ khoa học dữ liệu hội thảo kết quả thông báo tuyển sinh chương trình đào tạo".split()
    return " ".join(" ".join(rng.choice(words) for _ in range(12)).capitalize() + "." for _ in range(n))


LAYOUTS = {
    "cms": "<div id=header><ul class=menu>{menu}</ul></div><div class=sidebar><ul>{menu}</ul></div><h1>{title}</h1><span class=date>05/09/2026</span><div class=bodytext>{body}</div><div id=footer>{foot}</div>",
    "blog": "<header class=site-header><nav>{menu}</nav></header><article class=post><h1>{title}</h1><div class=entry-content>{body}</div></article><aside class=widget-area><ul>{menu}</ul></aside><footer>{foot}</footer>",
    "tables": "<table><tr><td><ul>{menu}</ul></td><td><table><tr><td>{body}</td></tr></table></td></tr><tr><td>{foot}</td></tr></table>",
    "nameless": "<div id=a1>{menu}</div><div id=a2><div id=a3>{body}</div><div id=a4><ul>{menu}</ul></div></div><div id=a5>{foot}</div>",
}


@pytest.mark.parametrize("layout", sorted(LAYOUTS))
def test_blocks_of_synthetic_layouts(layout):
    rng = random.Random(layout)
    menu = "".join(f"<li><a href=/m{k}>Mục {k}</a></li>" for k in range(9))
    right = found = total = 0
    for i in range(25):
        paragraphs = [para(rng) for _ in range(4)]
        html = "<html><head><title>t</title></head><body>" + LAYOUTS[layout].format(menu=menu, title=f"Tin {i}", body="".join(f"<p>{p}</p>" for p in paragraphs), foot="<p>Địa chỉ: số 1</p>") + "</body></html>"
        got, want = ex(html)["text"].split(), " ".join(paragraphs).split()
        right += len(set(got) & set(want)) and sum(min(got.count(w), want.count(w)) for w in set(want))
        found += len(got)
        total += len(want)
    p, r = right / found, right / total
    assert 2 * p * r / (p + r) >= 0.95


def test_dates_in_order_of_trust():
    html = '<meta property="article:published_time" content="2026-08-22T10:00:00+07:00"><p>Đăng ngày 05/09/2026</p>'
    assert ex(html)["published_at"] == "2026-08-22" and ex("<p>Đăng ngày 05/09/2026 10:30, rất dài và đủ chữ.</p>")["published_at"] == "2026-09-05"
    assert ex("<time datetime='2026-01-02'>x</time><p>a</p>")["published_at_src"] == "time" and ex("<p>31/02/2026</p>")["published_at"] == ""


def test_author_and_source_lines_are_cut():
    r = ex("<div class=content><p>Một đoạn văn dài, có dấu câu.</p><p>Nguồn: Báo A</p><p><strong>Tác giả: Nguyễn Văn B</strong></p></div>")
    assert (r["author"], r["author_src"], r["cited_source"]) == ("Nguyễn Văn B", "text-line", "Báo A") and "Tác giả" not in r["text"]
    assert ex("<meta name=author content=admin><p>Nội dung đây, dài.</p><p>Bài, ảnh: C D</p>")["author"] == "C D"
    assert ex("<p>Theo kế hoạch " + "rất dài " * 20 + ".</p>")["cited_source"] == ""


def test_json_ld_and_title_suffix():
    html = '<script type="application/ld+json">{"@graph":[{"headline":"Tin A","author":[{"name":"B"}],"datePublished":"2026-01-05"}]}</script><title>x</title><p>a b</p>'
    r = ex(html)
    assert (r["title"], r["title_src"], r["author"], r["published_at"]) == ("Tin A", "json-ld", "B", "2026-01-05")
    assert D.cut_suffix("Thông báo tuyển sinh 2026 - ĐH Bạch Lâm") == "Thông báo tuyển sinh 2026" and D.cut_suffix("A - B") == "A - B"
    assert ex('<script type="application/ld+json">{broken</script><p>a</p>')["text"] == "a"


def test_edges():
    html = """<nav><a href=/vi/>Trang chủ</a></nav><div class=content><p>Nội dung dài, có dấu câu, đủ hai mươi lăm chữ.</p>
    <a href="http://www.uni.example/t.pdf#x">Tải về</a><a href="https://uni.example/t.pdf">Tải về</a><a href="https://drive.google.com/f">Drive</a>
    <figure><img src=/anh.jpg><figcaption>Chú thích</figcaption></figure><img src=/themes/i.png alt=icon><a href=/b-2.html><img src=/c.png alt="Ảnh bìa"></a><a href="#top">x</a></div><footer><a href=/lien-he>Liên hệ</a></footer>"""
    r = ex(html)
    content = {(e["dst"], e["type"]): e for e in r["content_edges"]}
    assert content["https://uni.example/t.pdf", "href"]["count"] == 2 and content["https://uni.example/t.pdf", "href"]["dst_kind"] == "document"
    assert content["https://drive.google.com/f", "href"]["dst_kind"] == "external" and content["https://uni.example/anh.jpg", "embed"]["text"] == "Chú thích"
    assert content["https://uni.example/b-2.html", "href"]["text"] == "Ảnh bìa"
    assert {e["dst"] for e in r["nav_edges"]} == {"https://uni.example/vi/", "https://uni.example/themes/i.png", "https://uni.example/lien-he"}


def test_cleaning_and_trace():
    html = "<body><!-- c --><script>var a='</p>'</script><div style='display: none'>ẩn</div><div hidden>ẩn</div><form>f</form><p>Chữ <b>đậm<p>tiếp</body>"
    trace = {}
    r = ex(html, trace=trace)
    assert r["text"].split("\n") == ["Chữ", "đậm", "tiếp"] and trace["parsed"] >= trace["after_clean"] >= trace["block"]
    assert ex(html) == ex(html, trace={})
    assert "onclick" not in ex("<div class=content><p onclick=x>a</p><font>b</font><a href='/q\"'>c</a></div>")["html"]


def test_templates():
    shared = D.fingerprint("12 tin")
    assert shared == D.fingerprint(" 99  TIN ")
    page = D.parse("<ul><li>Menu chung</li></ul><p>Riêng trang này, dài.</p>")
    assert D.remove_template(page, frozenset([D.fingerprint("menu chung")])) == 1 and page.text(page.body, "", True) == "Riêng trang này, dài."


@pytest.mark.parametrize("html", ["", None, "<", "<p", "<table><td>a<td>b<tr>c", "</p></div>x", "<li><p>a<li>b", "<a href=x", "<p>" * 500, "&#x110000;&nbsp", "\x00"])
def test_broken_pages_never_fail(html):
    r = ex(html)
    assert r is None or isinstance(r["text"], str)


def test_selector():
    assert ex("<div class=a>một hai</div><div class=b>ba bốn</div>", selector=".b")["text"] == "ba bốn"


def test_nesting_of_any_depth():
    html = "<div>" * 5000 + "<p>Một đoạn văn dài, có dấu câu.</p>" + "</div>" * 5000
    got = ex(html)
    assert got["text"] == "Một đoạn văn dài, có dấu câu." and got["html"].startswith("<div>")


def test_downloads_and_template_images():
    r = ex("<div class=content><p>Một đoạn văn dài, có dấu câu.</p><a href='/x?download=10'>Tệp</a><img src='/a.jpg?from=/themes/'><img src='/themes/b.jpg'></div>")
    kinds = {e["dst"]: e["dst_kind"] for e in r["content_edges"]}
    assert kinds == {"https://uni.example/x?download=10": "document", "https://uni.example/a.jpg?from=/themes/": "image"}
    assert [e["dst"] for e in r["nav_edges"]] == ["https://uni.example/themes/b.jpg"]
