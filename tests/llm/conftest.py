import random
import sys
from pathlib import Path

import pytest

pytest.importorskip("cohortwright.llm")

sys.path.insert(0, str(Path(__file__).parent))

DOC_SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, uid string, kept int, quality string, "
    "n_words string, h double, bucket string, shard string, copies string, label string"
)


def edge_documents():
    """Nulls in every column, empty and very long texts, ties, copies, near copies and repeated rows."""
    random.seed(3)
    vocabulary = [f"w{i}" for i in range(300)] + ["The", "of", "and", "für", "ñandú", "it’s"]
    text = lambda n: " ".join(random.choice(vocabulary) for _ in range(n))
    base, shared, line = text(220), text(60), "All rights reserved " + text(6)
    near = base.split(" ")
    near[100] = "changed"
    texts = [
        None, "", "   \n\t ", "one", "One", "two words", "a b c", "A b  c\n", base, base, " ".join(near), base.upper(), base + "\n" + line,
        text(80) + " " + shared + " " + text(80), shared + " " + text(100), text(30) + "\n" + line, line + "\n" + line, text(20_000),
        "x" * 50_000, "rep " * 400, "Released under the MIT License.\nGNU General Public License and the Apache License", "\x00\x1f null bytes \x7f",
        "日本語 のテキスト です " * 20, "### *** $$$ %%% &&& | < >\n" * 30, text(49), text(50), text(51), shared,
    ]
    texts += [text(random.randint(20, 90)) + "\n" + (line if i % 2 else text(5)) for i in range(20)]
    rows = []
    for i, t in enumerate(texts):
        rows.append((i * 7 % 50 + (i // 50) * 100, t, ["en", None, "fr"][i % 3], None if i % 6 == 5 else f"s{i % 11}", None, "u", i, None, "3", 0.5, "b", "s", "c", "l"))
    rows += [rows[8], rows[8], rows[3]]  # repeated rows
    rows.append((None, base, None, None, None, None, None, None, None, None, None, None, None, None))
    rows.append((None, None, None, None, None, None, None, None, None, None, None, None, None, None))
    return rows


@pytest.fixture(scope="session")
def edges(spark, tmp_path_factory):
    """A folder of tables with edge cases, and their rows."""
    where = tmp_path_factory.mktemp("edges")
    rows = edge_documents()
    docs = spark.createDataFrame(rows, DOC_SCHEMA).repartition(3)
    docs.write.parquet(f"{where}/documents.parquet")
    words = rows[17][1].split(" ")
    items = [(1, " ".join(words[50:75]), "x"), (2, None, None), (3, "", "x"), (4, "two WORDS", "x"), (None, " ".join(words[70:81]), "x"), (1, " ".join(words[50:75]), "x"), (12, "the of and", "x")]
    spark.createDataFrame(items, "item_id bigint, text string, uid string").write.parquet(f"{where}/benchmark.parquet")
    labels = [(r[0], 1, int("MIT" in (r[1] or ""))) for r in rows if r[0] is not None] + [(None, 1, 1), (5, None, None)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    return str(where), [r.asDict() for r in spark.read.parquet(f"{where}/documents.parquet").collect()], [dict(zip(("item_id", "text"), i)) for i in items]


def article(i, extra="", after=""):
    body = "".join(f"<p>Paragraph {n} of story {i} says <b>what</b> no other page says{extra}.<br>It ends &amp; rests.</p>" for n in range(3))
    return f"<article><h1>Story {i}</h1>{body}</article>{after}"


def main_of(i, extra=""):
    return [f"Story {i}"] + [f"Paragraph {n} of story {i} says what no other page says{extra}. It ends & rests." for n in range(3)]


def edge_pages():
    """(page_id, url, html, blocks wanted): layouts with and without an article, template text of a host, broken and odd markup."""
    menu = "<nav><ul><li><a href='/a'>Home</a></li><li><a href='/b'>About</a></li></ul></nav>"
    tail = "<div class='comments'><p>Nice post!</p></div><footer>&copy; all</footer>"
    pages = [(i, f"https://one.example/{i}", f"<html><body>{menu}{article(i, after=tail)}</body></html>", main_of(i)) for i in range(4)]
    # A line of the layout inside the article of every page; copies of one page don't make its text a template.
    for i in range(10, 20):
        pages.append((i, f"http://user@two.example:80/{i}?q=1", f"<body>{menu}<article><h1>Story {i}</h1><p>Read our house rules first.</p><p>Only {i} has this.</p></article>", [f"Story {i}", f"Only {i} has this."]))
    pages += [(20 + i, "http://two.example/copy", "<body><article><h1>Copied</h1><p>The same everywhere.</p></article>", ["Copied", "The same everywhere."]) for i in range(30)]
    # No article: the element with most of the text outside of links.
    for i in range(60, 66):
        bar = "".join(f"<li><a href='/{n}'>Link number {n} of page {i}</a></li>" for n in range(8))
        pages.append((i, f"https://three.example/{i}", f"<body><div id=top><ul>{bar}</ul></div><div class=wrap><div class='box{i}'>{article(i)[9:-10]}</div></div><div>Made by three</div></body>", main_of(i)))
    odd = [
        (None, []), ("", []), ("   ", []), ("plain words only", ["plain words only"]),
        ("<article><p>one<p>two <i>t</i>hree</article>", ["one", "two three"]),
        ("<article><script>var a = '<p>no</p>';</script><style>p{}</style><!-- no --><p>yes &lt;p&gt; &#233;&nbsp;x</p>", ["yes <p> é x"]),
        ("<article><form><input><p>no</p></form><aside>no</aside><div class='ad-slot ad'>no</div><p hidden>no</p><span class=share>no</span><p>cut off &am", ["cut off &am"]),
        ("<main><h1>Head</h1><article><header><h2>Sub</h2></header><ul><li>a<li>b</ul><table><tr><td>c<td>d</table></article></main>", ["Head", "Sub", "a", "b", "c", "d"]),
        ("<header><p>no</p></header><div class=cookie-notice><p>no</p></div><main><p>5 < 6 and <a href='x>y'>z</a></p></main><section id=comments><article><p>no</p></article></section>", ["5 < 6 and z"]),
        ("<div>" * 3000 + "deep" + "</div>" * 3000, ["deep"]), ("<article><p>" + "long " * 200_000 + "</p></article>", [("long " * 200_000).strip()]),
    ]
    pages += [(100 + i, None if i % 2 else "no url at all", html, want) for i, (html, want) in enumerate(odd)]
    pages.append((None, None, "<article>null id</article>", ["null id"]))
    return pages + [pages[0]]


@pytest.fixture(scope="session")
def nothing(spark, tmp_path_factory):
    """A folder of empty tables."""
    where = tmp_path_factory.mktemp("nothing")
    spark.createDataFrame([], DOC_SCHEMA).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{where}/benchmark.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame([], "page_id bigint, url string, html string").write.parquet(f"{where}/pages.parquet")
    return str(where)
