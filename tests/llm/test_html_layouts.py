"""Hand-made page layouts, not drawn from the generator: what stands in braces is the article."""

import re
import time

import pytest

from cairnway.llm import html_text
from cairnway.llm.html_blocks import blocks_of

A = "The council met on Tuesday evening to talk about the new bridge over the river."
B = "Residents said that the old one had been closed for three years, and that nobody could tell them why."
C = "A report from the engineers is expected before the summer, the mayor told our reporter."
D = "Until then, buses will take the longer way round through the old town."
NAV = "<nav><a href=/>Home</a> <a href=/n>News</a> <a href=/s>Sports</a></nav>"
FOOT = "<footer><p>Copyright 2021 The Valley Post. All rights reserved.</p></footer>"
P = f"<p>{{{A}}}</p><p>{{{B}}}</p>"
Q = f"<p>{{{C}}}</p><p>{{{D}}}</p>"
LAYOUTS = [
    f"<body><div id='main'><p>{{{A} {B}}}</p></div><div><a>Imprint</a> <a>Privacy</a></div></body>",
    f"<article><section><h2>{{Part one}}</h2>{P}</section><section class='related'><h3>Related</h3><ul><li><a href=x>Another story</a></li><li><a href=y>More on this</a></li></ul></section></article>",
    f"<body>{NAV}<article><h1>{{A new bridge}}</h1>{P}</article>{FOOT}</body>",
    f"<body>{NAV}<main><h1>{{A new bridge}}</h1>{P}{Q}</main>{FOOT}</body>",
    f"<body><header><a href=/>The Valley Post</a></header><section>{P}{Q}</section>{FOOT}</body>",
    f"<body><div class=wrapper><div class=top><a href=/>Home</a></div><div class=post>{P}</div><div class=sidebar><h4>Popular</h4><ul><li><a>Cats</a></li><li><a>Dogs</a></li></ul></div></div></body>",
    f"<body>{P}</body>",
    f"<div>{P}{Q}</div>",
    f"<body><h1>{{A new bridge}}</h1>{P}{Q}</body>",
    f"<body><div><div><div>{P}</div></div></div></body>",
    f"<body><div id=page><div id=content><h1>{{A new bridge}}</h1>{P}<h2>{{What comes next}}</h2>{Q}</div><div id=comments><h3>2 Comments</h3><p>Ann says: what a waste</p><p>Bob says: finally!</p></div></div></body>",
    f"<body><article>{P}<aside><h3>Read more</h3><a href=1>Ten bridges</a></aside>{Q}</article></body>",
    f"<body><article>{P}<div class=ad>Advertisement: buy a boat today</div>{Q}</article>{FOOT}</body>",
    f"<body><div class=cookie-banner><p>We use cookies to make this site better.</p><button>Accept</button></div><main>{P}</main></body>",
    f"<body><article><header><h1>{{A new bridge}}</h1></header>{P}</article></body>",
    f"<body><form class=search><label>Search</label><input></form><div class=entry-content>{P}{Q}</div><form class=newsletter><p>Subscribe to our newsletter</p></form></body>",
    f"<body><article>{P}<ul><li>{{Steel for the deck, stone for the piers.}}</li><li>{{Two lanes for cars and one for bicycles.}}</li></ul></article></body>",
    f"<body><article>{P}<blockquote><p>{{We waited long enough for this day, said one of them.}}</p></blockquote>{Q}</article></body>",
    f"<body><article>{P}<figure><img><figcaption>{{The old bridge in the winter of last year.}}</figcaption></figure>{Q}</article></body>",
    f"<body><table><tr><td><a href=/>Home</a><br><a href=/a>About us</a></td><td>{P}{Q}</td></tr></table></body>",
    f"<body><div class=breadcrumb><a>Home</a> &gt; <a>News</a></div><div class=article-body>{P}</div><div class=share><a>Share</a> <a>Tweet</a></div></body>",
    f"<body>{NAV}<div class=story><p>{{{A}}}</p><p>{{{B}}}</p></div><div class=related-posts><h3>Related posts</h3><p><a>Bridges of the north</a></p></div>{FOOT}</body>",
    f"<body><section id=article><section>{P}</section><section>{Q}</section></section></body>",
    f"<body>{NAV}<article><section><h2>{{The vote}}</h2>{P}</section><section><h2>{{The money}}</h2>{Q}</section></article>{FOOT}</body>",
    f"<body><main><div><h1>{{A new bridge}}</h1><div>{P}</div><div>{Q}</div></div></main><aside><p><a>Weather</a></p></aside></body>",
    f"<body><div role=navigation><ul><li><a>Home</a></li><li><a>Shop</a></li></ul></div><div role=main>{P}</div><div role=contentinfo><p>Imprint</p></div></body>",
    f"<body>{NAV}<p>{{{A}}}</p><p>{{{B}}}</p><p>{{{C}}}</p>{FOOT}</body>",
    f"<body><div class=container><article class=post><h2>{{A new bridge}}</h2>{P}</article><div id=disqus_thread><p>Leave a comment</p></div></div></body>",
    f"<body><article><p>{{{A}}}<p>{{{B}}}<p>{{{C}}}</article></body>",
    f"<body><article><h1>{{A new bridge}}</h1>{P}</article><section class=comments><h3>Comments</h3><ul><li>Nice article!</li><li>Reply</li></ul></section>{FOOT}</body>",
    f"<body><div class=popup><p>Sign up for our mails</p></div><div class=text><p>{{{A} {B} {C}}}</p></div></body>",
    f"<body><header><nav><ul><li><a>One</a></li><li><a>Two</a></li><li><a>Three</a></li></ul></nav></header><main><article>{P}{Q}</article></main><footer><nav><ul><li><a>Terms</a></li><li><a>Privacy</a></li></ul></nav></footer></body>",
    f"<body><div id=header>The Valley Post</div><div id=menu><a>Home</a><a>News</a></div><div id=body>{P}{Q}</div><div id=footer>Copyright</div></body>",
    f"<body><article><h1>{{A new bridge}}</h1><dl><dt>{{Length of the bridge in metres}}</dt><dd>{{Two hundred and forty from bank to bank.}}</dd></dl>{P}</article></body>",
    f"<body><article>{P}<pre>{{span = 240 and width = 12 and lanes = 3}}</pre>{Q}</article></body>",
    f"<body><div class=content><div class=content-inner>{P}</div></div><div class=widget><h4>Archive</h4><ul><li><a>May</a></li></ul></div></body>",
    f"<body>{NAV}<div class=news><h1>{{A new bridge}}</h1><p>{{{A}}} <a href=x>{{Read the plan.}}</a></p>{Q}</div></body>",
    f"<body><main><article><h1>{{A new bridge}}</h1>{P}<section class=newsletter-signup><p>Subscribe to our newsletter</p></section>{Q}</article></main></body>",
    f"<body><div class=notice>This site uses cookies</div>{NAV}<section class=main-content>{P}<h3>{{What comes next}}</h3>{Q}</section><div class=sponsored><p>Sponsored: limited offer</p></div>{FOOT}</body>",
    f"<body><article><h1>{{Bridge}}</h1><p>{{{A}}}</p></article><div><p><a>Next story</a></p><p><a>Previous story</a></p></div></body>",
    f"<body>{NAV}<article>{P}{Q}{P}{Q}</article><aside class=sidebar><section><h3>Most read</h3><ol><li><a>One</a></li><li><a>Two</a></li></ol></section></aside>{FOOT}</body>",
    f"<body><article><h1>{{A new bridge}}</h1>{P}<hr>{Q}<p>{{Additional reporting by our staff in the valley.}}</p></article>{FOOT}</body>",
]


@pytest.fixture(scope="module")
def weights():
    return html_text.train()


def test_layouts_that_the_generator_does_not_draw(weights):
    pages = [p.replace("{", "").replace("}", "") for p in LAYOUTS]
    wanted = [[b.text for b in blocks_of(re.sub(r"\{[^{}]*\}", lambda m: f"\0{m[0][1:-1]}\0", p)) if "\0" in b.text] for p in LAYOUTS]
    assert len(pages) >= 40
    kept = lost = extra = 0
    for page, want, got in zip(pages, wanted, html_text.main_texts(pages, weights), strict=True):
        want, got = [w.replace("\0", "") for w in want], [g for g in got.split("\n\n") if g]
        hits = sum(w in got for w in want)
        kept, lost, extra = kept + hits, lost + len(want) - hits, extra + sum(g not in want for g in got)
        assert hits, page  # no article is lost whole
    assert kept / (kept + lost) >= 0.95 and kept / (kept + extra) >= 0.95, (kept, lost, extra)


def test_what_is_no_block_stays_in_its_sentence():
    texts = lambda page: [b.text for b in blocks_of(page)]
    assert texts("<p>The cost <meta itemprop=x> was high</p>") == ["The cost was high"]
    assert texts("<p>Press <button>OK</button> to <custom-mark>go</custom-mark> on</p>") == ["Press OK to go on"]
    assert texts("<p>a<svg/>b<svg><path/></svg>c</p>") == ["abc"]


def test_deep_pages_take_time_in_proportion():
    def seconds(n):
        start = time.perf_counter()
        assert len(blocks_of("".join(f"<div class=a{i}>x</p>" for i in range(n)))) == n
        return time.perf_counter() - start

    seconds(2_000)
    assert seconds(30_000) < 60 * seconds(3_000) / 2 + 1
