"""Pages written by hand, as sites lay them out, with the text that an extraction should give."""

A = "The council met on Tuesday evening to discuss the repairs of the old bridge, which has been closed since the spring floods."
B = "Engineers told the members that the work would take about eight months and cost rather more than was planned."
C = "Residents who spoke at the meeting asked for a footpath to be opened first, so that children could walk to school."
T = "Bridge to reopen next year"
NAV = '<ul><li><a href="/">Home</a></li><li><a href="/news">News</a></li><li><a href="/sport">Sport</a></li></ul>'
FOOT = "© 2021 The Valley Paper. All rights reserved."


def _page(body):
    return f"<!DOCTYPE html><html><head><title>{T}</title><script>var a = '<p>no</p>';</script></head><body>{body}</body></html>"


P = f"<p>{A}</p><p>{B}</p><p>{C}</p>"
ALL = f"{A}\n{B}\n{C}"
LAYOUTS = {
    "article": (_page(f"<nav>{NAV}</nav><article><h1>{T}</h1>{P}</article><footer><p>{FOOT}</p></footer>"), f"{T}\n{ALL}"),
    "main and aside": (_page(f"<header><a href='/'>The Valley Paper</a></header><main><h1>{T}</h1>{P}</main><aside><h3>Most popular</h3>{NAV}</aside>"), f"{T}\n{ALL}"),
    "tables": (_page(f"<table width=100%><tr><td colspan=2>The Valley Paper</td></tr><tr><td width=150>{NAV}</td><td><h1>{T}</h1>{P}</td></tr><tr><td colspan=2>{FOOT}</td></tr></table>"), f"{T}\n{ALL}"),
    "tables with breaks": (_page(f"<table><tr><td>Valley Paper Online</td></tr><tr><td><a href=/>Home</a><br><a href=/a>Archive</a><br></td><td><h2>{T}</h2><p>{A}<p>{B}</td></tr><tr><td>Copyright 1999</td></tr></table>"), f"{T}\n{A}\n{B}"),
    "text in body": (_page(f"{A}<p>{B}<p>{C}"), ALL),
    "heading and text in body": (_page(f"<h1>{T}</h1>{A}<br><br><p>{B}</p>"), f"{T}\n{A}\n{B}"),
    "body with rule": (_page(f"{NAV}<h1>{T}</h1><p>{A}</p><p>{B}</p><hr><small>{FOOT}</small>"), f"{T}\n{A}\n{B}"),
    "comment list": (_page(f"<article><h1>{T}</h1>{P}</article><h3>3 responses</h3><ol class='commentlist'><li class='comment'><p>Great post! I walk there every day with my dog.</p></li><li class='comment'><p>I disagree. It costs far too much.</p></li></ol>"), f"{T}\n{ALL}"),
    "comments in div": (_page(f"<div class='post'><h2>{T}</h2>{P}</div><div id='comments'><div class='comment-body'>Anna says: thanks for sharing this.</div><div class='comment-body'>When will it open?</div></div>"), f"{T}\n{ALL}"),
    "question": (_page(f"<div class='notice'>We use cookies to improve your experience.</div><div id='question-header'><h1>How do I close a file?</h1></div><div class='question'><div class='vote'>12</div><div class='post-text'><p>{A}</p></div><div class='user-info'>asked 3 days ago bob</div></div><div class='answer'><div class='vote'>4</div><div class='post-text'><p>{B}</p></div></div>"), f"How do I close a file?\n{A}\n{B}"),
    "documentation": (_page(f"<div class='sphinxsidebar'>{NAV}</div><div class='body' role='main'><h1>{T}</h1><p>{A}</p><div class='admonition note'><p class='admonition-title'>Note</p><p>{B}</p></div><p>{C}</p></div>"), f"{T}\n{A}\nNote\n{B}\n{C}"),
    "blog of divs": (_page(f"<div id='wrapper'><div class='header'>My little blog</div><div class='post'><div class='title'>{T}</div><div class='meta'>Posted by Ann on 3.4.2011</div><div class='post-body'>{P}</div></div><div class='footer'>Powered by Press</div></div>"), f"{T}\n{ALL}"),
    "stray apostrophe": (_page(f"<article><h1>{T}</h1><p><b don't>It's</b> {A}</p><p>{B}</p></article>"), f"{T}\nIt's {A}\n{B}"),
    "unclosed paragraphs": (_page(f"<article><h1>{T}</h1><p>{A}<p>{B}<p>{C}</article><footer>{FOOT}</footer>"), f"{T}\n{ALL}"),
    "newsletter box": (_page(f"<article><h1>{T}</h1><p>{A}</p><div class='newsletter'><p>Subscribe to our newsletter</p><form><label>Enter your email</label><button>Sign up</button></form></div><p>{B}</p></article>"), f"{T}\n{A}\n{B}"),
    "advert inside": (_page(f"<main><h1>{T}</h1><p>{A}</p><div class='ad-slot'>Advertisement</div><p>{B}</p></main>"), f"{T}\n{A}\n{B}"),
    "cookie banner": (_page(f"<div class='cookie-banner'><p>We use cookies to improve your experience.</p><button>Accept all</button></div><article><h1>{T}</h1>{P}</article>"), f"{T}\n{ALL}"),
    "lists": (_page(f"<nav>{NAV}</nav><article><h1>{T}</h1><p>{A}</p><ul><li>Eight months of work</li><li>A path for walkers first</li></ul><p>{B}</p></article>"), f"{T}\n{A}\nEight months of work\nA path for walkers first\n{B}"),
    "quotation": (_page(f"<article><h1>{T}</h1><p>{A}</p><blockquote>{C}</blockquote><p>{B}</p></article><footer>{FOOT}</footer>"), f"{T}\n{A}\n{C}\n{B}"),
    "table in text": (_page(f"<article><h1>{T}</h1><p>{A}</p><table><tr><td>Spring</td><td>survey of the piers</td></tr></table><p>{B}</p></article>"), f"{T}\n{A}\nSpring\nsurvey of the piers\n{B}"),
    "code": (_page(f"<main class='content'><h1>{T}</h1><p>{A}</p><pre><code>open('bridge.txt')</code></pre><p>{B}</p></main>"), f"{T}\n{A}\nopen('bridge.txt')\n{B}"),
    "deep divs": (_page(f"<div><div class='wrap'><div><div class='nav-list'>{NAV}</div><div class='inner'><div class='article-body'><h1>{T}</h1>{P}</div></div></div></div></div>"), f"{T}\n{ALL}"),
    "related links": (_page(f"<article><h1>{T}</h1>{P}</article><div class='related'><h3>Related articles</h3><ul><li><a href=/1>Flood damage put at two million</a></li><li><a href=/2>Ferry runs on Sundays</a></li></ul></div>"), f"{T}\n{ALL}"),
    "sections": (_page(f"<nav>{NAV}</nav><section class='content'><h1>{T}</h1><h2>What was said</h2><p>{A}</p><h2>What comes next</h2><p>{B}</p></section><footer>{FOOT}</footer>"), f"{T}\nWhat was said\n{A}\nWhat comes next\n{B}"),
    "share bar": (_page(f"<article><h1>{T}</h1><div class='share social'><a href=#>Share this</a> <a href=#>Follow us</a></div>{P}</article>"), f"{T}\n{ALL}"),
    "breadcrumbs": (_page(f"<div class='breadcrumb'><a href=/>Home</a> » <a href=/n>News</a></div><div class='entry-content'><h1>{T}</h1>{P}</div><div class='site-footer'>{FOOT}</div>"), f"{T}\n{ALL}"),
    "entities": (_page(f"<article><h1>Fish &amp; chips</h1><p>{A} &ldquo;Good,&rdquo; they said.</p></article>"), f"Fish & chips\n{A} “Good,” they said."),
    "hidden script in text": (_page(f"<article><h1>{T}</h1><p>{A}</p><script>if (a < b) document.write('<p>x</p>')</script><p>{B}</p></article>"), f"{T}\n{A}\n{B}"),
    "search form first": (_page(f"<form class='search'><label>Search</label><input name=q></form><nav>{NAV}</nav><main><h1>{T}</h1>{P}</main>"), f"{T}\n{ALL}"),
    "author box": (_page(f"<article><h1>{T}</h1>{P}</article><div class='author-box'><h3>About the author</h3><p>Ann writes for the paper.</p></div><footer>{FOOT}</footer>"), f"{T}\n{ALL}"),
    "pager": (_page(f"<div id='content'><h1>{T}</h1>{P}</div><div class='pagination'><a href=/1>Previous</a> <a href=/2>Next page</a></div>"), f"{T}\n{ALL}"),
    "nothing": (_page("<script>go()</script>"), ""),
}

D = "The bridge carries the only road between the two halves of the town, and buses now take a way round of eleven miles."
L = "".join(f'<a href="/{k}">{w}</a> ' for k, w in enumerate(("Start", "Politics", "Weather", "Letters", "Jobs")))
THREE = f"{A}\n{B}\n{D}"


def _divs(*texts, of="<div>{}</div>"):
    return "".join(of.format(t) for t in texts)


#: Layouts of which the grammar has none: other nestings, other names, other languages' names, other orders.
UNSEEN = {
    "spans in divs": (_page(f"<div>{L}</div><div><div><h1>{T}</h1>{_divs(A, B, D, of='<div><span>{}</span></div>')}</div></div><div>{FOOT}</div>"), f"{T}\n{THREE}"),
    "german names": (_page(f"<div id='kopf'>Talblatt</div><div id='navigation-links'>{NAV}</div><div id='inhalt'><h1>{T}</h1>{P}</div><div id='fuss'>{FOOT}</div>"), f"{T}\n{ALL}"),
    "french names": (_page(f"<div class='entete'>Le Journal</div><ul class='rubriques'><li><a href=/>Accueil</a><li><a href=/m>Monde</a></ul><div class='corps'><h2>{T}</h2>{P}</div><div class='pied'>{FOOT}</div>"), f"{T}\n{ALL}"),
    "names of a compiler": (_page(f"<div class='x1f9a'>{L}</div><div class='x7c2b'><h1 class='xaa1'>{T}</h1>{_divs(A, B, D, of=chr(60) + 'p class=\"x55e\">{}</p>')}</div><div class='x9d0'>{FOOT}</div>"), f"{T}\n{THREE}"),
    "numbered ids": (_page(f"<div id='d1'>{NAV}</div><div id='d2'><h1>{T}</h1>{P}</div><div id='d3'>{FOOT}</div>"), f"{T}\n{ALL}"),
    "title after text's box begins": (_page(f"<div><nav>{NAV}</nav></div><div><div><div><h1>{T}</h1></div><div>{P}</div></div></div>"), f"{T}\n{ALL}"),
    "section per paragraph": (_page(f"<main><h1>{T}</h1>{_divs(A, B, D, of='<section><p>{}</p></section>')}</main><footer>{FOOT}</footer>"), f"{T}\n{THREE}"),
    "definition list": (_page(f"<nav>{NAV}</nav><article><h1>{T}</h1><p>{A}</p><dl><dt>Span</dt><dd>Ninety feet, of stone</dd><dt>Built</dt><dd>In the year 1790</dd></dl><p>{B}</p></article>"), f"{T}\n{A}\nSpan\nNinety feet, of stone\nBuilt\nIn the year 1790\n{B}"),
    "menu behind the text": (_page(f"<main><h1>{T}</h1>{P}</main><nav>{NAV}</nav>"), f"{T}\n{ALL}"),
    "mail list page": (_page(f"<div>{L}</div><h1>{T}</h1><pre>{A}</pre><pre>{B}</pre><hr><div>{FOOT}</div>"), f"{T}\n{A}\n{B}"),
    "center and font": (_page(f"<center><font size=5>The Valley Paper</font></center><p>{L}</p><h2>{T}</h2><p><font face=arial>{A}</font></p><p><font face=arial>{B}</font></p><center><small>{FOOT}</small></center>"), f"{T}\n{A}\n{B}"),
    "text by breaks in a cell": (_page(f"<table><tr><td>{NAV}</td><td>{A}<br><br>{B}<br></td></tr></table>"), f"{A} {B}"),
    "caption": (_page(f"<article><h1>{T}</h1><figure><img src=a.jpg><figcaption>The bridge in April, seen from the mill on the east side.</figcaption></figure>{P}</article><footer>{FOOT}</footer>"), f"{T}\nThe bridge in April, seen from the mill on the east side.\n{ALL}"),
    "skip link": (_page(f"<a href='#m'>Skip to content</a><header>{L}</header><main id=m><h1>{T}</h1>{P}</main><footer>{FOOT}</footer>"), f"{T}\n{ALL}"),
    "roles": (_page(f"<div role=banner>The Valley Paper</div><div role=navigation>{NAV}</div><div role=main><h1>{T}</h1>{P}</div><div role=contentinfo>{FOOT}</div>"), f"{T}\n{ALL}"),
    "press release": (_page(f"<div class='topline'>{L}</div><div class='release'><h1>{T}</h1><h2>Work begins in May</h2>{P}</div><div class='bottomline'>{FOOT}</div>"), f"{T}\nWork begins in May\n{ALL}"),
    "long list": (_page(f"<nav>{NAV}</nav><article><h1>{T}</h1><ol><li>{A}</li><li>{B}</li><li>{D}</li></ol></article>"), f"{T}\n{THREE}"),
    "two columns": (_page(f"<div class='cols'><div class='c1'>{NAV}</div><div class='c2'><h1>{T}</h1><p>{A}</p><p>{D}</p></div></div><div class='end'>{FOOT}</div>"), f"{T}\n{A}\n{D}"),
    "consent at the end": (_page(f"<article><h1>{T}</h1>{P}</article><div class='consent'><p>We use cookies to improve your experience.</p><a href=#>Accept all</a></div>"), f"{T}\n{ALL}"),
    "no end tags": (f"<html><head><title>{T}</title><body><nav>{NAV}</nav><article><h1>{T}</h1><p>{A}<p>{B}<p>{D}", f"{T}\n{THREE}"),
}
