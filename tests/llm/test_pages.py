"""Pages written by hand, unlike those that the models are fitted on; words found and words that should not be."""

import collections
import time

from quillspan.llm import html_extraction

BLOG = """<!doctype html><html lang=en><head><meta charset=utf-8><title>Why we moved our boats</title><link rel=stylesheet href=a.css>
<body class="home single"><div id="top-bar"><a href="/">River Journal</a> <a href="/about">About</a> <a href="/shop">Shop</a></div>
<div class="cookie-banner">We use cookies to improve your visit. <button>Accept</button></div>
<div class="page-wrap"><div class="post-body"><h1>Why we moved our boats</h1>
<p>For eleven years the club kept its boats under the old railway bridge, where the water is calm and the bank is low enough to launch from.
<p>Last winter the council closed the path. Nobody told us until the gate was locked, and by then the ice had already come up to the hulls.</p>
<blockquote><p>&ldquo;You could hear the planks complaining all night,&rdquo; said the keeper, who lives across the water.</p></blockquote>
<p>So in March, with three borrowed trailers &amp; a good deal of shouting, we carried everything two miles upstream.</p></div>
<div class="share-buttons"><a href="#">Tweet</a> <a href="#">Share</a> <a href="#">Pin it</a></div>
<section id="comments"><h3>2 comments</h3><div class="comment"><p>Great read, thanks for posting this!</p></div><div class="comment"><p>I remember the old bridge well.</p></div></section></div>
<div class="sidebar"><h4>Popular posts</h4><ul><li><a href="/1">Ten knots to know</a><li><a href="/2">Winter varnish</a></ul></div>
<footer><p>&copy; 2024 River Journal. All rights reserved.</p></footer></body></html>"""
BLOG_TEXT = """Why we moved our boats For eleven years the club kept its boats under the old railway bridge, where the water is calm and the bank is low enough to launch from.
Last winter the council closed the path. Nobody told us until the gate was locked, and by then the ice had already come up to the hulls.
\u201cYou could hear the planks complaining all night,\u201d said the keeper, who lives across the water.
So in March, with three borrowed trailers & a good deal of shouting, we carried everything two miles upstream."""

NEWS = """<html><head><script>var a = "<p>not text</p>";</script></head><body><header class="site-header"><nav><ul><li><a href="/w">World</a></li><li><a href="/s">Sport</a></li><li><a href="/b">Business</a></li></ul></nav></header>
<main><article><header><h1>Harbour wall to be rebuilt by spring</h1></header><figure><img src=x.jpg></figure>
<p>The harbour wall that fell during the storms in January will be rebuilt by spring, the port authority said on Tuesday.</p>
<div class="ad-slot">Advertisement: Save 20% on garden furniture this week only</div>
<p>Engineers have been working from barges since the beginning of the month, because the road along the quay cannot carry heavy cranes.</p>
<p>The work is expected to cost four million, most of which will come from an emergency fund, and the rest from harbour dues.</p>
<ul><li>The northern pier stays open to small craft.</li><li>Ferries use the outer berth until further notice.</li></ul></article></main>
<aside class="related"><h2>More on this story</h2><ul><li><a href="/x">Storm damage in pictures</a></li><li><a href="/y">Ferries resume after gale</a></li></ul></aside>
<form class="newsletter"><label>Sign up for our morning email</label><input name=e><button>Subscribe</button></form>
<footer><ul><li><a href="/t">Terms</a></li><li><a href="/p">Privacy</a></li></ul></footer></body></html>"""
NEWS_TEXT = """Harbour wall to be rebuilt by spring The harbour wall that fell during the storms in January will be rebuilt by spring, the port authority said on Tuesday.
Engineers have been working from barges since the beginning of the month, because the road along the quay cannot carry heavy cranes.
The work is expected to cost four million, most of which will come from an emergency fund, and the rest from harbour dues.
The northern pier stays open to small craft. Ferries use the outer berth until further notice."""

DOCS = """<html><body><div class="navbar"><a href="/">Docs</a><a href="/api">API</a><a href="/faq">FAQ</a><form class="search"><input name=q></form></div>
<div class="toc"><ul><li><a href="#i">Install</a></li><li><a href="#c">Configure</a></li><li><a href="#r">Run</a></li></ul></div>
<div role="main" class="content"><h1>Getting started</h1><p>This guide shows how to set up the scheduler on a single machine. It takes about ten minutes.</p>
<h2 id=i>Install</h2><p>Download the archive and unpack it in a folder of your choice. The folder must be writable.</p><pre>tar xf scheduler.tgz</pre>
<h2 id=c>Configure</h2><p>Open the settings file in an editor, and set the number of workers to the number of cores that you want to give away.</p>
<table><tr><th>Name</th><th>Meaning</th></tr><tr><td>workers</td><td>how many tasks run at once</td></tr></table></div>
<div class="pagination"><a href="/p">Previous</a> <a href="/n">Next</a></div><div class="footer">Built with care. Report a problem.</div></body></html>"""
DOCS_TEXT = """Getting started This guide shows how to set up the scheduler on a single machine. It takes about ten minutes.
Install Download the archive and unpack it in a folder of your choice. The folder must be writable. tar xf scheduler.tgz
Configure Open the settings file in an editor, and set the number of workers to the number of cores that you want to give away.
Name Meaning workers how many tasks run at once"""

OLD = """<HTML><BODY BGCOLOR=white><TABLE WIDTH=100%><TR><TD COLSPAN=2><A HREF="i.html">Home</A> | <A HREF="l.html">Links</A> | <A HREF="g.html">Guestbook</A>
<TR><TD WIDTH=120><UL><LI><A HREF="1.html">Part one</A><LI><A HREF="2.html">Part two</A></UL><TD><H1>The clockmaker's notes</H1>
<P>My grandfather repaired clocks in a room above the bakery, and he kept notes on every one of them in a green ledger.
<P>The first entry is from 1931. A mantel clock, he wrote, that loses four minutes a day and belongs to a man who does not mind.
<P>I have copied the entries as they stand, with their spelling, and added a word of explanation only where his hand cannot be read.</TABLE>
<HR><CENTER><FONT SIZE=1>Last updated 3 May 1999. Best viewed at 800x600.</FONT></CENTER></BODY></HTML>"""
OLD_TEXT = """The clockmaker's notes My grandfather repaired clocks in a room above the bakery, and he kept notes on every one of them in a green ledger.
The first entry is from 1931. A mantel clock, he wrote, that loses four minutes a day and belongs to a man who does not mind.
I have copied the entries as they stand, with their spelling, and added a word of explanation only where his hand cannot be read."""

PAGES = [(BLOG, BLOG_TEXT), (NEWS, NEWS_TEXT), (DOCS, DOCS_TEXT), (OLD, OLD_TEXT)]


def test_pages_written_by_hand():
    found = right = wanted = 0
    for got, (_, text) in zip(html_extraction.extract_all([p for p, _ in PAGES], html_extraction.models()), PAGES, strict=True):
        a, b = collections.Counter(got.split()), collections.Counter(text.split())
        found, right, wanted = found + a.total(), right + (a & b).total(), wanted + b.total()
    print(f"recall {right / wanted:.3f}, precision {right / found:.3f}")
    assert right >= 0.95 * wanted and right >= 0.9 * found


def test_parsing_is_linear():
    for unit in ("<select ", "<select>", '<a "', "<a ='>", "<p><select>", "<h1><dt></dt>", "<!--", "<title>", "<", "<script>", "<object><p>", "<div></p>", "&amp;", "<li><b"):
        for end in ("", ">", "</select>", "</object>" * 5000):
            began = time.perf_counter()
            html_extraction.Page(unit * (500_000 // len(unit)) + end)
            assert time.perf_counter() - began < 5, unit
