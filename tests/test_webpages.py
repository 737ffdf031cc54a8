"""Pairs of names from lists in lists and from tables."""

from tessella.sources.webpages import list_pairs, table_pairs

LISTS = """<ul class="a"><li>Oak Street
 <ul><li>Elm St</li><li> <b>Ash</b> &amp; Co </li><li></li></ul></li>
<li>Plain</li><LI><a href="x">Pine</a><br>since 1940<ul><li>Fir</li></ul><ul><li>second list</li></ul></LI></ul>"""
TABLE = """<table class="wikitable"><tr><th>n</th></tr><tr><td>no</td><td>no</td></tr></table><h2><span id="Renamed_streets">R</span></h2><p>x</p>
<table class="sortable wikitable x"><tr><td>new</td><td>old</td></tr><tr><td>Main&nbsp;St</td><td><i>First</i>
 St</td><td>y</td></tr><tr><td>Only</td></tr><tr><td>Empty</td><td> </td></tr></table>"""


def test_pairs(spark):
    pages = spark.createDataFrame([(1, LISTS), (2, TABLE), (3, ""), (4, None), (1, LISTS), (5, "<li>a<ul>")], "id int, body string")
    got = sorted(map(tuple, list_pairs(pages, "body", ["id"]).collect()))
    once = [(1, "Oak Street", "Ash & Co"), (1, "Oak Street", "Elm St"), (1, "Pine", "Fir")]
    assert got == sorted(once * 2)
    assert [tuple(r) for r in table_pairs(pages, "body", "Renamed_streets", "wikitable", ["id"]).collect()] == [(2, "Main St", "First St")]
    assert list_pairs(pages.limit(0), "body", ["id"]).collect() == []
