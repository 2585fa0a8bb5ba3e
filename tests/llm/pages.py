"""Whole pages as sites of several kinds write them, each with the text of its article."""

NEWS = """<!doctype html><html lang="en"><head><meta charset="utf-8"><title>Harbour reopens - The Daily Lantern</title><script>window.dataLayer=[]</script><style>.x{color:red}</style></head>
<body class="article-page">
<a class="skip-link" href="#main">Skip to content</a>
<div id="cookie-banner" role="dialog"><p>We use cookies to improve your visit.</p><button>Accept all</button></div>
<header class="site-header"><a href="/" class="logo">The Daily Lantern</a><nav class="main-menu"><ul><li><a href="/news">News</a></li><li><a href="/sport">Sport</a></li><li><a href="/weather">Weather</a></li></ul></nav><form class="search" action="/s"><input name="q"><button>Search</button></form></header>
<main id="main"><article class="story"><h1>Harbour reopens after winter storm</h1>
<p>The harbour was opened to ships again on Tuesday, eleven days after a storm had torn away part of the old pier.</p>
<p>&ldquo;We worked through every night,&rdquo; said the harbour master. Repairs cost about &euro;2&nbsp;million.</p>
<div class="ad-slot"><span>Advertisement</span><p>Save on your next ferry ticket.</p></div>
<h2>What comes next</h2><p>Two of the three cranes are in use; the third one is to follow in May.</p>
<ul><li>Ferries run by the summer timetable.</li><li>Fishing boats moor at the northern quay.</li></ul>
<blockquote>The sea always has the last word.</blockquote></article>
<aside class="related-posts"><h3>Read more</h3><ul><li><a href="/1">Storm in pictures</a></li><li><a href="/2">Pier to be rebuilt</a></li></ul></aside>
<section id="comments" class="comments"><h3>2 comments</h3><div class="comment"><p>Great news for the whole town, thanks to everybody who helped.</p></div><div class="comment"><p>About time!</p></div></section></main>
<footer class="site-footer"><p>&copy; 2024 The Daily Lantern. All rights reserved.</p><ul><li><a href="/imprint">Imprint</a></li><li><a href="/privacy">Privacy</a></li></ul></footer></body></html>"""
NEWS_TEXT = "Harbour reopens after winter storm The harbour was opened to ships again on Tuesday, eleven days after a storm had torn away part of the old pier. “We worked through every night,” said the harbour master. Repairs cost about €2 million. What comes next Two of the three cranes are in use; the third one is to follow in May. Ferries run by the summer timetable. Fishing boats moor at the northern quay. The sea always has the last word."

BLOG = """<html><body><div class="wrapper"><div class="top"><div class="logo"><a href="/">Tin Can Notes</a></div><div class="navbar"><a href="/a">About</a> <a href="/b">Archive</a></div></div>
<div class="content"><div class="post"><div class="post-body"><h2>Soldering without tears</h2><p>I broke three irons before I learned this.<p>Heat the pad, not the tin. The tin flows to where it is <em>hot</em>, and so <strong>it tells you</strong> when you are done.
<pre>iron = 350</pre><p>That is all there is to it; the rest is practice and a wet sponge.</div></div>
<div class="share"><a href="#">Share</a> <a href="#">Pin it</a></div></div>
<div class="sidebar"><div class="widget"><h4>Recent posts</h4><ul><li><a href="/x">A better vice</a><li><a href="/y">Why flux matters</a></ul></div></div>
<div class="copyright">&copy; 2019 tincan.example</div></div></body></html>"""
BLOG_TEXT = "Soldering without tears I broke three irons before I learned this. Heat the pad, not the tin. The tin flows to where it is hot, and so it tells you when you are done. iron = 350 That is all there is to it; the rest is practice and a wet sponge."

MATHS = """<html><head><title>Notes</title></head><body><nav><ol class="breadcrumb"><li><a href="/">Home</a></li><li><a href="/notes">Notes</a></li></ol></nav>
<article><h1>Energy of a body at rest</h1><p>The energy is <math><mi>E</mi><mo>=</mo><mi>m</mi><msup><mi>c</mi><mn>2</mn></msup></math> for a body at rest, and more if it moves along.</p>
<p>See the drawing <svg width="10"><title>t</title><text>rest frame</text></svg> for its frame of reference, which is drawn in grey.</p>
<noscript><p>The drawing is also printed on page nine of the notes, in black and white.</p></noscript></article>
<footer><p>&copy; Notes &middot; <a href="/legal">Legal</a></p></footer></body></html>"""
MATHS_TEXT = "Energy of a body at rest The energy is E=mc2 for a body at rest, and more if it moves along. See the drawing rest frame for its frame of reference, which is drawn in grey. The drawing is also printed on page nine of the notes, in black and white."

UTILITY = """<html><body><div class="flex flex-col items-center px-4 py-2 bg-white banner"><a href="/">Shop of Maps</a></div><div class="flex gap-2 px-4 menu"><a href="/1">Maps</a><a href="/2">Globes</a><a href="/3">Basket</a></div>
<div class="max-w-3xl mx-auto px-4 py-8 leading-7 article-body"><h1 class="text-2xl font-bold">How old maps were coloured</h1><p class="mt-4">Colour was laid on by hand, sheet after sheet, long after the plate had been printed.</p><p class="mt-4">Green stood for woods, yellow for fields. Red was kept for borders, as it was the dearest of all.</p><p class="mt-4">A good hand did forty sheets a day.</p></div>
<div class="max-w-3xl mx-auto px-4 py-8 mt-8 border-t text-gray-500 gap-4 comments"><p>My grandfather coloured maps in Augsburg, it ruined his eyes.</p></div>
<div class="px-4 py-8 text-xs text-gray-400 footer">&copy; 2023 Shop of Maps</div></body></html>"""
UTILITY_TEXT = "How old maps were coloured Colour was laid on by hand, sheet after sheet, long after the plate had been printed. Green stood for woods, yellow for fields. Red was kept for borders, as it was the dearest of all. A good hand did forty sheets a day."

GUIDE = """<!DOCTYPE html><html><body><div role="banner"><a href="/">Docs</a></div><div role="navigation"><ul><li><a href="/start">Start</a></li><li><a href="/api">Reference</a></li></ul></div>
<div role="main" class="page-content"><h1>Setting up the press</h1><p>Level the bed first. A press that leans prints uneven lines, whatever you do later on.</p><h2>Ink</h2><p>Use as little as you can.</p><table><tr><td>Black</td><td>Two turns of the key give an even film on the roller.</td></tr><tr><td>Red</td><td>Three turns, as the pigment is coarser than that of black.</td></tr></table><p>Clean the rollers every evening with oil and a soft cloth.</p></div>
<div class="subscribe newsletter"><p>Get our letters by mail.</p><form><input><button>Subscribe</button></form></div><div role="contentinfo"><p>&copy; Press Guild</p></div></body></html>"""
GUIDE_TEXT = "Setting up the press Level the bed first. A press that leans prints uneven lines, whatever you do later on. Ink Use as little as you can. Black Two turns of the key give an even film on the roller. Red Three turns, as the pigment is coarser than that of black. Clean the rollers every evening with oil and a soft cloth."

PLAIN = """<html><body><header><h1><a href="/">Valley Choir</a></h1></header><nav><a href="/">Home</a> | <a href="/dates">Dates</a></nav><div class="alert">The office is closed on Friday.</div><section class="entry-content"><p>The choir sings on the first Sunday of every month, in the old mill by the river.</p><p>New voices are welcome. You need not read music, but you should like to get up early.</p></section><aside class="sponsored"><p>Sheet music at half price</p></aside><footer>&copy; Valley Choir</footer></body></html>"""
PLAIN_TEXT = "The choir sings on the first Sunday of every month, in the old mill by the river. New voices are welcome. You need not read music, but you should like to get up early."

PAGES = [(NEWS, NEWS_TEXT), (BLOG, BLOG_TEXT), (MATHS, MATHS_TEXT), (UTILITY, UTILITY_TEXT), (GUIDE, GUIDE_TEXT), (PLAIN, PLAIN_TEXT)]
