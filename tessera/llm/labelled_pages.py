"""Pages labelled by hand, from which the extraction model of ``html_extract`` learns all its weights.

``y=1`` marks an element as main text and ``y=0`` as anything else; an element without a mark has its parent's.
"""

LOREM = (
    "The river was low that summer and the ferries stopped running in July.",
    "Nobody in the village could remember a year like it, though the oldest of them tried.",
    "Prices rose by four percent, the ministry said, and were expected to rise again before winter.",
    "A short one.",
    "She opened the letter at the table, read it twice, and put it back into its envelope without a word to anyone.",
    "In the second part we look at how the samples were taken, which of them were kept, and why the rest were not.",
    "Rain, wind and a late train.",
    "The bridge will be closed until the end of May.",
    "He waited for an answer, but none came.",
)


def pages(turn: int) -> tuple[str, ...]:
    """The labelled pages with their sentences moved on by ``turn``: what a sentence is must not decide."""
    t = LOREM[turn:] + LOREM[:turn]
    return (
        f'<html y=0><body><div id="topbar"><a>Sign in</a> <a>Help</a></div><div class="columns"><div class="col-main" y=1><h1>{t[3]}</h1><div class="byline" y=0>By A. Writer, <a>follow</a></div><p>{t[0]}</p><p>{t[4]} {t[1]}</p><h2>{t[6]}</h2><p>{t[5]}</p></div><div class="col-side"><h4>Popular</h4><ol><li><a>{t[2]}</a></li><li><a>{t[0]}</a></li></ol><div class="ad-slot">{t[1]}</div></div></div><footer>Legal. Contact. Jobs.</footer></body></html>',
        f'<html y=0><body><form action=s><input><button>Find</button></form><section class="story" y=1><h1>{t[6]}</h1><p>{t[2]}</p><p>{t[3]}</p><div class="advertisement" y=0><p>{t[4]}</p></div><p>{t[5]}</p><p>{t[1]}</p></section><section class="discussion" y=0><h2>Readers write</h2><ul class="comment-list"><li class="comment"><p>{t[0]}</p></li><li class="comment"><p>{t[6]}</p></li></ul><form><textarea></textarea><button>Post</button></form></section><nav class="footer-nav"><a>Up</a></nav></body></html>',
        f'<html y=0><body><article y=1><h1>{t[2]}</h1><p>{t[0]}<p>{t[1]}<p>{t[6]}</article><div class="banner"><p>{t[5]}</p></div><div class="newsletter"><p>{t[3]}</p><form><input></form></div><div class="alert notice"><p>{t[4]}</p></div><div class="sidebar"><div><p>{t[0]}</p></div></div><footer><div><p>{t[1]}</p></div></footer></body></html>',
        f'<html y=0><body><nav><ol><li>{t[3]}</li><li>{t[0]}</li></ol></nav><div class="ad"><p>{t[0]} {t[2]}</p></div><aside>{t[5]} {t[4]}</aside><main y=1><p>{" ".join(t)}</p><h2>{t[3]}</h2><blockquote>{t[1]}</blockquote><p>{t[6]}</p></main><header><p>{t[4]}</p></header><footer>{" ".join(t[2:5])}</footer></body></html>',
        f'<html y=0><body><header><a>Logo</a><h1>Daily Paper</h1></header><nav class="menu"><a>Front</a> <a>Opinion</a> <a>Archive</a></nav><main y=1><article><h1>{t[6]}</h1><p>{t[4]}</p><p>{t[5]}</p><ul><li>{t[3]}</li><li>{t[6]}</li></ul><p>{t[1]}</p></article></main><aside class="sidebar" y=0><h3>Most read</h3><ul><li><a>{t[3]}</a></li><li><a>{t[6]}</a></li></ul></aside><section class="comments" y=0><h3>Comments</h3><div class="comment"><p>{t[6]}</p></div><div class="comment"><p>Great read, thank you!</p></div></section><footer><p>Imprint and contact.</p></footer></body></html>',
        f'<html y=0><body><div id="header"><p>Welcome to the site</p></div><div id="nav"><ul><li><a>One</a></li><li><a>Two</a></li></ul></div><div id="content" y=1><h2>{t[6]}</h2><p>{t[0]}</p><p>{t[2]} <a>See the tables</a>.</p><blockquote><p>{t[4]}</p></blockquote><div class="ad advert" y=0><p>Sponsored: new shoes at half price.</p></div><p>{t[5]}</p><div class="share social" y=0><a>Share</a> <a>Tweet</a></div></div><div id="footer">Terms, privacy, cookies</div></body></html>',
        f'<html y=0><body><div class="cookie-notice banner">We use cookies to improve the site. <button>Accept</button></div><header class="site-header"><form><label>Search</label><input><button>Go</button></form></header><div class="post entry" y=1><h1 class="title">{t[3]}</h1><div class="entry-content"><p>{t[1]}</p><p>{t[4]}</p><pre>x = 1\ny = 2</pre><p>{t[0]}</p><table><tr><td>Year</td><td>Sum</td></tr><tr><td>1999</td><td>12</td></tr></table></div></div><div class="related" y=0><h3>Related</h3><p><a>{t[6]}</a></p></div><form class="newsletter"><p>Sign up for our letter.</p><input></form><div class="footer">Copyright</div></body></html>',
        f'<html y=0><body><div class="wrapper"><div class="top"><a>Log in</a> <a>Register</a></div><div class="main" y=1><article><header><h1>{t[6]}</h1></header><section><h2>{t[3]}</h2><p>{t[5]}</p><p>{t[2]}</p></section><section><h2>More</h2><p>{t[1]}</p><figure><figcaption>{t[6]}</figcaption></figure></section><aside class="notice" y=0><p>Subscribe now to read on.</p></aside></article></div><div class="right-col sidebar"><p>Weather: sun.</p><ul><li><a>Tags</a></li><li><a>News</a></li></ul></div></div><div id="comments"><p>{t[4]}</p><p>First!</p><form><textarea></textarea></form></div><footer><nav><a>About</a></nav></footer></body></html>',
        f'<html y=0><body><nav><ul><li><a>A</a></li></ul></nav><div class="notice">The shop is closed on Monday.</div><article y=1><h1>{t[0]}</h1><p>{t[4]}</p><p>{t[3]}</p><ol><li>{t[1]}</li><li>{t[2]}</li></ol><h3>{t[6]}</h3><p>{t[5]}</p></article><section id="comments" class="reader-comments"><article class="comment"><p>{t[2]}</p></article><article class="comment"><p>{t[3]}</p></article></section><div class="ads"><p>{t[6]}</p></div><footer>Contact</footer></body></html>',
        f'<html y=0><body><div class="breadcrumb"><a>Home</a> &gt; <a>Garden</a></div><main y=1><h1>{t[3]}</h1><p>{t[0]}</p><p>{t[1]}</p><p>{t[2]}</p><div><p>{t[4]}</p><div>{t[5]}</div></div></main><div class="promo banner">Win a trip to the sea.</div><ul class="pagination"><li><a>1</a></li><li><a>2</a></li></ul><footer>{t[6]}</footer></body></html>',
        f'<html y=0><body><header><div class="logo">Site</div></header><section class="content article" y=1><h1>{t[6]}</h1><div class="text">{t[2]}</div><div class="text">{t[4]}</div><div class="text">{t[3]}</div><dl><dt>River</dt><dd>{t[0]}</dd></dl></section><aside><p>{t[1]}</p><form><p>Your mail</p></form></aside><div class="popup modal"><p>Join us and save.</p></div><footer class="site-footer"><ul><li>Jobs</li><li>Press</li></ul></footer></body></html>',
        f'<html y=0><body><nav>Menu</nav><article y=1><p>{t[0]}</p>{t[1]}<p>{t[2]}</p></article><footer>&copy; 2020 &middot; {t[3]} {t[4]}</footer></body></html>',
        f'<html y=0><body><div class="ad">{t[5]}</div><article y=1><h1>{t[2]}</h1><div>{t[3]}</div></article><div class="comments"><p>{t[0]}</p><p>{t[1]}</p></div><footer><p>{t[6]}</p><p>{t[2]}</p></footer></body></html>',
        f'<html y=0><body><header><p>{t[1]}</p></header><main y=1><p>{t[4]}</p><p>{t[0]}</p><p>{t[6]}</p><aside y=0><p>{t[2]}</p><p>{t[5]}</p></aside><p>{t[3]}</p><div class="comments" y=0><p>{t[1]}</p></div></main><div class="sidebar"><p>{t[3]}</p></div></body></html>',
        f'<html y=0><body><nav><p>{t[2]}</p></nav><div class="article-body" y=1><ul><li>{t[0]}</li><li>{t[1]}</li><li>{t[5]}</li></ul><table><tr><td>{t[3]}</td><td>{t[6]}</td></tr></table><dl><dt>{t[6]}</dt><dd>{t[4]}</dd></dl></div><form><p>{t[4]}</p><label>{t[6]}</label></form><section class="comments"><article><p>{t[0]}</p></article><div>{t[5]}</div></section><aside>{t[4]}</aside><div class="notice"><p>{t[1]}</p></div></body></html>',
        f'<html y=0><body><nav><ul><li><a>{t[3]}</a></li><li><a>{t[6]}</a></li></ul></nav><main y=1><article><h1>{t[6]}</h1><p>{t[4]} {t[2]}</p><h2>{t[3]}</h2><p>{" ".join(t)}</p><pre>{t[3]}</pre></article></main><section class="comments"><h3>Comments</h3><article class="comment"><p>{t[1]} {t[2]}</p></article></section><footer><p>{t[0]}</p></footer></body></html>',
        f'<article y=1><h1>{t[3]}</h1><p>{t[6]}<br>{t[1]}</p></article><footer y=0>{t[2]}</footer>',
        f'<html y=0><body><article y=1><p>{t[3]}</p><p>{t[6]}</p></article></body></html>',
        f'<html y=0><body><header>{t[1]}</header><article y=1><p>{" ".join(t)}</p><p>{" ".join(t[::-1])}</p><p>{t[3]}</p><p>{t[1]} {t[5]}</p></article><aside><p>{t[0]}</p></aside><footer>{t[2]} {t[4]}</footer></body></html>',
        f'<article y=1><p>{t[0]}<p>{t[3]}</article>',
        f'<article y=1><p>{t[6][:11]}<p>{t[3][:7]}<br>{t[2][:9]} <b>{t[0][:9]}</article>',
        f'<div class="content" y=1><p>{t[6][:14]}</p><p>{t[5]}</p></div><div class="footer" y=0>{t[1][:20]}</div>',
        f'<html y=0><body><article y=1><p>{t[0]}</p></article></body></html>',
        f'<html y=0><body><nav><a>{t[6][:9]}</a></nav><main y=1><p>{t[3]}</p></main><footer>{t[1][:30]}</footer></body></html>',
    )


TURNS = (0, 2, 4)
PAGES = tuple(p for turn in TURNS for p in pages(turn))
