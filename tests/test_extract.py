"""Extraction contract (X*) on hand-written inputs."""

from pyspark.sql import functions as F

from folio.operators import extract as X
from folio.functions.text import html_to_text, snippet, title_from_stem

MD = """---
title: Front Title
author: Someone
---
# Main Heading

Intro with a [link](https://example.com/a) and an image ![alt text](/img/x.png).

## Section Two

```python
print(1)
```

### Third
"""

PY = '''"""Module docstring first line.

More text."""
import os
from sys import path
import json

class Widget:
    def method_a(self):
        pass

    def method_b(self):
        pass

def helper():
    return 1

def other():
    return 2
'''

HTML = """<html><head><title>Page Title</title><meta name="description" content="d">
<meta name="keywords" content="k"><style>.x{}</style><script>var a = 1;</script></head>
<body><h1>Heading</h1><p>Body text</p><a href="/x">link</a><img src="a.png"></body></html>"""


def one(spark, text, fn, path="/docs/readme_file.md"):
    return fn(spark.createDataFrame([(path, text)], "path string, content string")).first()


def test_markdown(spark):
    r = one(spark, MD, X.extract_markdown)
    assert len(r["headers"]) == 3 and r["headers"][0]["level"] == 1
    assert len(r["links"]) == 1 and r["links"][0]["url"] == "https://example.com/a"
    assert len(r["images"]) == 1 and r["images"][0]["alt"] == "alt text"
    assert r["frontmatter"]["title"] == "Front Title"
    assert r["md_title"] == "Main Heading"
    assert [t["anchor"] for t in r["toc"]] == ["main-heading", "section-two", "third"]
    assert r["code_blocks"][0]["language"] == "python" and r["code_blocks"][0]["lines"] == 1
    assert r["reading_time"] == 1


def test_markdown_without_front_matter(spark):
    r = one(spark, "plain text only\n", X.extract_markdown)
    assert r["frontmatter"] is None
    assert r["md_title"] == "Readme File"


def test_text_stats(spark):
    df = spark.createDataFrame([("one two three four five\nsix seven eight nine",), ("a b\nc d\ne f\n",)], "content string")
    rows = X.text_stats(df).collect()
    assert (rows[0]["line_count"], rows[0]["word_count"]) == (2, 9)
    assert (rows[1]["line_count"], rows[1]["word_count"]) == (3, 6)


def test_json(spark):
    df = spark.createDataFrame([('{"a": 1, "b": 2, "c": 3}',), ("[1, 2, 3, 4, 5]",), ('{"broken": ',)], "content string")
    r = X.json_info(df).collect()
    assert r[0]["valid"] and r[0]["key_count"] == 3 and r[0]["keys"] == ["a", "b", "c"]
    assert r[1]["array_length"] == 5 and r[1]["keys"] is None
    assert not r[2]["valid"] and r[2]["content"] == '{"broken": '


def test_yaml(spark):
    r = one(spark, "name: x\nversion: 1\nitems:\n  - a\n  - b\n", X.yaml_info)
    assert r["key_count"] == 3


def test_python(spark):
    r = one(spark, PY, X.python_info, "/src/my_module.py")
    assert len(r["imports"]) == 3
    assert "Widget" in r["classes"] and {"helper", "other", "method_a"} <= set(r["functions"])
    assert r["py_title"] == "Module docstring first line."


def test_python_without_docstring(spark):
    r = one(spark, "import os\n\ndef f():\n    pass\n", X.python_info, "/src/my_module.py")
    assert r["docstring"] is None and r["py_title"] == "My Module"


def test_html(spark):
    df = spark.createDataFrame([(HTML,)], "html string")
    r = X.html_info(df).first()
    assert r["html_title"] == "Page Title"
    assert len(r["meta_tags"]) == 2
    assert (r["link_count"], r["image_count"], r["heading_count"]) == (1, 1, 1)
    assert "var a" not in r["text"] and ".x" not in r["text"] and "Body text" in r["text"]


def test_meta_order_quotes_and_repeats(spark):
    html = """<meta content='a "b" > c' name=one><META property="og:t" content="x=1 name='no'">
    <meta charset="utf-8"><meta name='two'><meta name="one" content="last"/><meta name="">"""
    rows = spark.createDataFrame([(1, html), (2, ""), (3, None)], "i int, html string")
    got = {r["i"]: r["meta_tags"] for r in X.html_info(rows).collect()}
    assert got == {1: {"one": "last", "og:t": "x=1 name='no'", "two": ""}, 2: {}, 3: None}


def test_snippet_and_title(spark):
    long = "word " * 100
    df = spark.createDataFrame([(long, "/a/my-file_name.txt")], "c string, p string")
    r = df.select(snippet("c").alias("s"), title_from_stem("p").alias("t")).first()
    assert r["s"].endswith("...") and len(r["s"]) <= 203
    assert r["t"] == "My File Name"


def test_html_text_entities(spark):
    df = spark.createDataFrame([("<p>a &amp; b</p>",)], "h string")
    assert df.select(html_to_text("h")).first()[0] == "a & b"
