"""Main text of page layouts: names of classes and ids that mean something else, quoted attributes, wrappers; and layouts put together at random, whose text is known."""

import random

import pytest

from webloom.llm.html_text import main_text

P1 = "The quick story of the river and the town is that it was there for all of the people who had come to live with it, and they were glad of the water in the summer."
P2 = "When the mill was built by the old family, it had been the first of its kind in the valley, and there was much talk of it in the inns and at the market."


def page(body):
    return f"<html><head><title>t</title></head><body><nav><a href='/'>Home</a> <a href='/x'>News</a></nav>{body}<footer>Copyright by us</footer></body></html>"


A = f"<p>{P1}</p><p>{P2}</p>"
W = P1 + "\n" + P2
CASES = {
 "overflow":(f'<div class="overflow-hidden"><article>{A}</article></div>',W),
 "overflow2":(f'<article><h1>Title</h1><div class="overflow-hidden">{A}</div></article>',"Title\n"+W),
 "md":(f'<article><h1>Title</h1><div class="md:hidden x">{A}</div></article>',"Title\n"+W),
 "data":(f'<article data-menu="hidden">{A}</article>',W),
 "title":(f'<article><div title="a hidden gem">{A}</div></article>',W),
 **{n:(f'<article><div class="{n}">{A}</div></article>',W) for n in ("market-share","social-policy","search-engine-history","ad-hoc-query")},
 **{"id"+n:(f'<article><div id="{n}">{A}</div></article>',W) for n in ("market-share","social-policy","search-engine-history","ad-hoc-query")},
 "sidebarwrap":(f'<div class="page has-sidebar"><div><h1>Head line</h1>{A}</div></div>',"Head line\n"+W),
 "wrap2":(f'<div class="sidebar">{A}</div>',W),
 "biblio":(f'<article>{A}<ul><li><a href="/b">Schmidt, Karl; Meyer, Anna; Weber, Johann: Annalen Physik Chemie, Verlag Springer, Berlin 1923, Band 4</a></li></ul><p>{P1}</p></article>',W+"\nSchmidt, Karl; Meyer, Anna; Weber, Johann: Annalen Physik Chemie, Verlag Springer, Berlin 1923, Band 4\n"+P1),
 "code":(f'<div>{A}<div>'+"x = foo(bar); "*20+f'</div><p>{P1}</p></div>',W+"\n"+("x = foo(bar); "*20).strip()+"\n"+P1),
 "label":(f'<article>{A}<p><label>Important:</label> {P1}</p></article>',W+"\nImportant: "+P1),
 "h1before":(f'<h1>The headline</h1><article>{A}</article>',"The headline\n"+W),
 "comments":(f'<article>{A}<div class="comments"><p>{P1}</p></div></article>',W),
 "comments2":(f'<article>{A}</article><div id="comment-list"><article class="comment"><p>{P1}</p></article></div>',W),
 "share":(f'<article>{A}<div class="share-buttons"><a href="/f">Share this</a></div></article>',W),
 "related":(f'<article>{A}<aside><p>{P1}</p></aside><div class="related-posts"><p>{P2}</p></div></article>',W),
 "form":(f'<article>{A}<form><p>{P1}</p><label>Mail</label></form></article>',W),
 "formpage":(f'<form id="aspnetForm"><article>{A}</article></form>',W),
 "cookie":(f'<div class="cookie-banner"><p>{P1}</p></div><main>{A}</main>',W),
 "newsletter":(f'<article>{A}<div class="newsletter-signup">Sign up now</div></article>',W),
 "ad":(f'<article><p>{P1}</p><div class="ad">{P2}</div><p>{P2}</p></article>',W),
 "adslot":(f'<article><p>{P1}</p><div class="ad-slot top">{P2}</div><p>{P2}</p></article>',W),
 "hiddencls":(f'<article>{A}<div class="hidden">{P2}</div></article>',W),
 "quote":('<article><div data-x=\'class="comments" hidden\'>'+A+'</div></article>',W),
 "all-hidden":(f'<div hidden><p>{P1}</p></div>',""),
 "scripted":(f'<noscript>{P1}</noscript>',""),
}


@pytest.mark.parametrize("name", CASES)
def test_layout(name):
    body, want = CASES[name]
    assert main_text(page(body)) == want


#: Names that mark nothing, and names that mark what is not the article.
PLAIN = ["", "overflow-hidden", "md:hidden lg:block", "entry-content", "post", "has-sidebar page", "market-share", "col-8 main-column", "u-hidden-print x", "story__text", "notices-of-the-court", "c-1 c-2", "lead", "navy-blue", "tagline-free", "headers-and-cookies-explained"]
MARKED = ["comments", "sidebar", "cookie-banner", "site-footer", "newsletter-box", "share-buttons", "ad", "ad-slot", "related-posts", "social_links", "popup", "main-nav", "promoButton"]


def build(seed):
    """A page and its text: an article or a page of divs, wrappers of any name, and parts that are not the article between, before and after."""
    rnd = random.Random(seed)
    prose = lambda: " ".join(rnd.choice([P1, P2, "It was the end of the day, and the boats of the town came back with what they had got from the lake, as they did in all the years before."]) for _ in range(rnd.randint(1, 3)))
    attribute = lambda: rnd.choice([' class="{}"', ' id="{}"', " class='{}'", ' data-x="hidden" class="{}"', ' title="a class=&quot;ad&quot; > hidden menu" class="{}"']).format(rnd.choice(PLAIN))
    outside = lambda: rnd.choice([f'<div class="{rnd.choice(MARKED)}"><p>{prose()}</p></div>', f"<nav{attribute()}><a href=/>{P1}</a></nav>", f'<div style="display: none">{prose()}</div>', f"<div hidden>{prose()}</div>", f"<script>var x = '<p>{P1}</p>';</script>", f"<!-- {P2} -->", f'<div role="navigation"><p>{P1}</p></div>', f"<aside><p>{prose()}</p></aside>"])
    want, body = [], []
    for _ in range(rnd.randint(1, 6)):
        text = prose()
        if rnd.random() < 0.3:
            want.append("A heading of the part")
            body.append(f"<h2{attribute()}>A heading of the part</h2>")
        want.append(text)
        inner = text.replace("the town", f"<a href='/town'{attribute()}>the town</a>") if rnd.random() < 0.5 else text
        body.append(f"<p{attribute()}>{inner}</p>" if rnd.random() < 0.7 else f"<div{attribute()}><span>{inner}</span></div>")
        if rnd.random() < 0.4:
            body.append(outside())
    made = "".join(body)
    for _ in range(rnd.randint(0, 3)):
        made = f"<div{attribute()}>{made}</div>"
    if rnd.random() < 0.6:
        made = f"<article{attribute()}>{made}</article>"
    for _ in range(rnd.randint(0, 2)):
        made = f"<div{attribute()}>{made}</div>"
    return page("".join(outside() for _ in range(rnd.randint(0, 2))) + made + "".join(outside() for _ in range(rnd.randint(0, 2)))), "\n".join(want)


@pytest.mark.parametrize("first", range(0, 600, 100))
def test_random_layouts(first):
    for seed in range(first, first + 100):
        html, want = build(seed)
        assert main_text(html) == want, (seed, html)
