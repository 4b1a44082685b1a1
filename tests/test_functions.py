"""Text, Markdown, vector and version functions against fixed values and properties."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.functions import markdown as M
from corpusloom.functions import text as X
from corpusloom.functions import vectors as V
from corpusloom.functions import versions


def value(spark, column, **row):
    schema = ", ".join(f"{k} {'long' if isinstance(v, int) else 'string'}" for k, v in row.items())
    return spark.createDataFrame([tuple(row.values())], schema).select(column.alias("v")).first()["v"]


def test_highlight(spark):
    text = "Two herons wade where one heron slept."
    assert value(spark, X.highlight(F.col("t"), "HERON slept"), t=text) == "Two <b>heron</b>s wade where one <b>heron</b> <b>slept</b>."
    assert value(spark, X.highlight_count(F.col("t"), "HERON slept"), t=text) == 3
    assert value(spark, X.highlight(F.col("t"), "é a.b"), t="É a.b axb") == "É <b>a.b</b> axb"


def test_clean_and_hash(spark):
    assert value(spark, X.clean_markdown(F.col("t")), t="a  \t b<!-- x\ny -->c\n\nd<!-- open") == "a bc\n\nd"
    same = [value(spark, X.content_hash(F.col("t")), t=t) for t in ("a b", "a \t b<!-- c -->")]
    assert same[0] == same[1]


def test_tokens(spark):
    assert value(spark, X.tokens(F.col("t")), t="Éa_b 한국어를 straße x-1") == ["ea", "b", "한국어를", "straße", "x", "1"]


def test_links(spark):
    text = "[[A]] [[B|b]] [t](x.md) [u](https://a.b) doc://proj/12). [[A]]"
    assert value(spark, X.links(F.col("t")), t=text) == ["A", "B", "x.md", "doc://proj/12"]


def test_tags_and_toc(spark):
    assert value(spark, X.body_tags(F.col("t")), t="#one x#no `#code` #two/a\n```\n#fence\n```\n#1no #one") == ["one", "two/a"]
    assert value(spark, X.toc(F.col("t")), t="# A\ntext\n## B\n   ### C") == "- A\n  - B\n    - C"


def test_byte_range_widens_to_characters(spark):
    text = "ä" * 100
    got = value(spark, X.byte_range(F.col("t"), F.lit(61), F.lit(63), 0), t=text)
    assert got == "ää"


def test_paths(spark):
    for path, ok in (("a/b.md", True), ("../x", False), ("a//b", False), ("", False), ("/a", False)):
        assert value(spark, X.valid_path(F.col("t")), t=path) is ok
    assert value(spark, X.sanitise_title(F.col("t")), t='a/b:c"d') == "a_b_c_d"
    assert value(spark, X.display_path(F.col("p"), F.col("r"), F.col("n")), p="/v/notes/notes/a.md", r="/v/notes", n="notes") == "a.md"


def test_sections_skip_fences_and_frontmatter():
    text = "---\n# no: 1\n---\n# A\n```\n# no\n```\n## B\nx"
    assert [(h, level) for h, level, *_ in M.sections(text)] == [("# A", 1), ("## B", 2)]


def test_chunks_by_section():
    got = M.chunks("# Tides\nebb\n\n### Moon\nneap and spring")
    assert [(c["heading_path"], c["content"]) for c in got] == [("# Tides", "# Tides\nebb"), ("### Moon", "### Moon\nneap and spring")]
    long = M.chunks("# H\n" + "kelp" * 350, 500)
    assert len(long) >= 3 and all(len(c["content"]) <= 750 for c in long)
    assert M.chunks("") == [] and M.chunks("lead\n\n# H\nx")[0]["heading_path"] is None
    assert [c["heading_path"] for c in M.chunks("lead\n\n# H\nx", keep_lead=False)] == ["# H"]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab é.\n#!", max_size=600), st.integers(20, 80))
def test_chunks_cover_and_slice(text, limit):
    found = M.chunks(text, limit, limit // 5)
    raw = text.encode()
    for i, c in enumerate(found):
        assert c["chunk_index"] == i
        assert raw[c["start_byte"] : c["end_byte"]].decode().strip() == c["content"]
        assert len(c["content"]) <= 2 * limit + 2
    covered = bytearray(len(raw))
    for c in found:
        covered[c["start_byte"] : c["end_byte"]] = b"\1" * (c["end_byte"] - c["start_byte"])
    assert all(covered[i] or chr(raw[i]).isspace() for i in range(len(raw)))


def test_summary():
    assert M.summary("---\na: b\n---\nOne two. Three! Four? Five.") == "One two. Three! Four?"
    assert M.summary("---\ndescription: \"short\"\n---\nx") == "short"
    assert M.summary("# A\nx\n## B") == "[목차: # A, ## B]"
    assert M.summary("") == "" and len(M.summary("x" * 900)) == 503


def test_frontmatter_and_metadata():
    assert M.frontmatter("---\nk: v: w\n---\n\nbody") == ([("k", "v: w")], "body")
    assert M.frontmatter("---\nk: v\nbody")[0] is None
    got = M.metadata("---\ntitle: T\ntags: [a, b]\naliases:\n - x\n - 'y'\ncreated: 2024-02-29\n---\n")
    assert got == {"title": "T", "created": "2024-02-29", "tags": ["a", "b"], "aliases": ["x", "y"]}


def test_section_edits():
    text = "# A\nx\n## A1\nq\n# B\ny\n"
    assert M.extract_section(text, "a") == "# A\nx\n## A1\nq\n"
    assert M.edit_section(text, "B", "delete") == "# A\nx\n## A1\nq\n"
    assert M.edit_section(text, "A1", "replace", "new") == "# A\nx\n## A1\nnew\n# B\ny\n"
    with pytest.raises(KeyError):
        M.edit_section(text, "C", "delete")


def test_html_and_markdown():
    code = '<ac:structured-macro ac:name="code"><ac:parameter ac:name="language">py</ac:parameter><ac:plain-text-body><![CDATA[a<b]]></ac:plain-text-body></ac:structured-macro>'
    assert M.storage_to_markdown(f"<p>Hi <b>x</b></p>{code}") == "Hi **x**\n\n```py\na<b\n```"
    assert M.storage_to_markdown('<ac:link><ri:page ri:content-title="P"/></ac:link>') == "[P](P)"
    assert M.storage_to_markdown(" ") == ""
    assert "<table>" in M.markdown_to_html("| a | b |\n|---|---|\n| 1 | ~~2~~ |") and "<del>2</del>" in M.markdown_to_html("~~2~~")


def test_arrow_columns(spark):
    df = spark.createDataFrame([("# A\nx\n\n# B\ny",), (None,)], "t string")
    got = df.select(M.chunk_column(F.col("t")).alias("c"), M.summary_column(F.col("t")).alias("s"), M.section_column(F.col("t")).alias("x")).collect()
    assert [len(r["c"]) for r in got] == [2, 0] and got[1]["s"] == "" and got[0]["x"][1]["start_byte"] == 7
    M.register(spark)
    assert spark.sql("select doc_summary('One. Two. Three. Four.') s, size(doc_chunks('# A')) n").first()[0] == "One. Two. Three."


def test_quantise_and_cosine(spark):
    df = spark.createDataFrame([([0.5, -0.00390625, 1.0, -1.0], [0.0, 0.0, 0.0, 0.0])], "a array<float>, b array<float>")
    r = df.select(V.quantize_i8(F.col("a")).alias("q"), V.cosine(F.col("a"), F.col("b")).alias("z"), V.cosine(F.col("a"), F.col("a")).alias("o")).first()
    assert r["q"] == [64, -1, 127, -128] and r["z"] == 0.0 and r["o"] == pytest.approx(1.0)


def test_embedders(spark):
    df = spark.createDataFrame([("hello world",), ("hello world",), (None,)], "t string")
    rows = [np.array(r[0]) for r in df.select(V.embed(F.col("t"))).collect()]
    assert np.allclose(rows[0], rows[1]) and len(rows[0]) == 384 and np.linalg.norm(rows[0]) == pytest.approx(1)
    assert df.select(F.size(V.embed(F.col("t"), "none"))).first()[0] == 0


def test_versions():
    assert versions.satisfies("1.2.3", "^1.1") and not versions.satisfies("2.0.0", "^1.1") and versions.satisfies("0.2.5", "^0.2.3") and not versions.satisfies("0.3.0", "^0.2.3")
    assert versions.satisfies("1.2.3", "1.2.3") and not versions.satisfies("1.2.4", "1.2.3") and versions.satisfies("1.2.9", "~1.2.3") and versions.satisfies("2.1.0", ">=2,<3")
    assert versions.safe_base_url("https://example.com/x") and not versions.safe_base_url("http://example.com")
    assert not any(map(versions.safe_base_url, ("https://127.0.0.1", "https://10.0.0.1/x", "https://a.local", "https://localhost", "https://[::1]/")))
