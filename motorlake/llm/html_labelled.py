"""The labelled table for the tree of html_blocks: pages as (html, keep) of each block, in page order.

The pages are written by hand after common layouts: with and without elements for
content, with wrappers whose names sound like furniture, with menus of links and of
plain words, comments, forms and notices. Words in {braces} stand for the sentences below.
"""

SENTENCES = {
    "a": "The ferry left the harbour shortly before six, and by the time the fog had lifted we could see the first of the islands lying low and green on the horizon.",
    "b": "Engineers had warned for years that the old bridge would not carry the traffic that the new port was going to bring, but nobody wanted to pay for another one.",
    "c": "Bake the loaf for forty minutes, turn it over, and knock on its underside: a hollow sound tells you that the crumb is done.",
    "d": "Prices rose again in March.",
    "e": "It rained.",
    "f": "In the second experiment the mice that had been fed at night gained twice as much weight as those that had been fed by day, although both groups had eaten the same amount, which suggests that the clock and not the calories made the difference.",
    "g": "She opened the letter, read it twice and put it back.",
    "h": "Wer im Herbst durch die Wälder geht, hört zuerst das Laub und erst viel später die Vögel, die noch nicht gezogen sind.",
    "i": "Le marché ouvre à sept heures, et les premiers clients arrivent avec leurs paniers avant que les étals soient prêts.",
    "j": "We use cookies to improve this site and to measure how it is used; by going on you agree to our policy.",
    "k": "Sign up for our weekly letter and get the best stories in your inbox every Friday, free of charge and without obligation.",
    "l": "Great read, thank you so much, I have been to that island myself and can only agree with what you say about the fog there.",
    "m": "All rights reserved. No part of this site may be reproduced without written permission of the publisher.",
    "n": "Save up to forty percent on winter tyres this week only, in all our shops and online, while stocks last.",
    "o": "Our newsroom has been reporting from the valley since 1961 and is owned by its readers, who elect the board each year.",
    "p": "By Anna Berg, 3 May",
    "q": "The council will vote on Tuesday.",
}
_MENU = [("<ul><li><a href=/>Home</a>", 0), ("<li><a href=/n>News and views</a>", 0), ("<li><a href=/s>Sport</a></ul>", 0)]

_PAGES = [
    # elements for content
    [("<nav>", None), *_MENU, ("</nav><div class=ad>{n}</div>", 0), ("<article><h1>Fog over the islands</h1>", 1), ("<p>{a}</p>", 1), ("<p>{e}</p>", 1), ("<p>{b}</p></article>", 1), ("<footer>{m}</footer>", 0)],
    [("<nav><ul><li><a href=1>One</a>", 0), ("<li><a href=2>Two</a></ul></nav>", 0), ("<div class=ad>{d}</div>", 0), ("<article><h1>{q}</h1>", 1), ("<p><b>{d}</b></p>", 1), ("<p>{g}</p>", 1), ("<footer>&copy; 2020 {q}</footer></article>", 0)],
    [("<header><a href=/>The Valley Post</a></header>", 0), ("<main><h1>A bridge too old</h1>", 1), ("<p>{b} <a href=1>Read the report</a></p>", 1), ("<p><a href=2>Our earlier story on this</a></p>", 1), ("<aside>{o}</aside>", 0), ("<p>{d}</p>", 1), ("<form>{k}</form>", 0), ("<p>{f}</p></main>", 1), ("<footer>{m}</footer>", 0)],
    [("<div class='page has-sidebar'><header>The Post</header>", 0), ("<article class='post social-science'><header><h1>Mice and clocks</h1>", 1), ("<p class=byline>{p}</p></header>", 1), ("<p>{f}</p>", 1), ("<p class=related-topic>{a}</p>", 1), ("<ul><li><a href=1>First study</a>", 1), ("<li><a href=2>Second study of the mice</a></ul>", 1), ("<address>Institute, Long Road 4</address></article>", 1), ("<div class=sidebar>{o}</div>", 0), ("<p>{d}</p></div>", 0)],
    [("<form id=page-form><div class=menu><a href=1>Home</a></div>", 0), ("<article><div class=entry-header><h1>Bread</h1></div>", 1), ("<p>{c}</p>", 1), ("<p>{g}</p>", 1), ("<div class=share><a href=2>Share this</a></div>", 0), ("<div class=comments><h3>Two comments</h3>", 0), ("<p>{l}</p>", 0), ("<p>{g}</p></div></article></form>", 0)],
    [("<main><h1>The harbour at dawn</h1>", 1), ("<article><p>{a}</p>", 1), ("<p>{i}</p></article>", 1), ("<section id=comments><h2>Comments</h2>", 0), ("<article class=comment><p>{l}</p></article>", 0), ("<article class=comment><p>{e}</p></article></section></main>", 0)],
    [("<article><h1>Wald</h1>", 1), ("<p>{h}</p>", 1), ("<p>{h} {h}</p></article>", 1), ("<article><p>{l}</p></article>", 0), ("<article><p>{g}</p></article>", 0), ("<div>{m}</div>", 0)],
    [("<div class=notice>{j}</div>", 0), ("<main><nav><a href=1>Start</a> <a href=2>Part two</a></nav>", 0), ("<h2>{d}</h2>", 1), ("<p>{b}</p>", 1), ("<div class='ad banner'>{n}</div>", 0), ("<blockquote>{g}</blockquote>", 1), ("<table><tr><td>Year", 1), ("<td>Price</td></tr></table>", 1), ("<div class=newsletter>{k}</div></main>", 0)],
    [("<p>{o}</p>", 0), ("<article><p>{d}</p>", 1), ("<p>{e}</p></article>", 1), ("<p>{a}</p>", 0), ("<p>{b}</p>", 0)],
    [("<div><a href=1>Home</a> | <a href=2>About</a></div>", 0), ("<article class=content-with-ads><h1>Market</h1>", 1), ("<p>{i}</p>", 1), ("<div class=ad-slot>{n}</div>", 0), ("<p>{d}</p>", 1), ("<dialog>{j}</dialog>", 0), ("<p><a href=3>{q}</a></p>", 1), ("<div class=comment-list><p>{l}</p></div></article>", 0)],
    [("<header><h1>The Valley Post</h1>", 0), ("<p>{q}</p></header>", 0), ("<main><header><h2>{g}</h2></header>", 1), ("<p>{f}</p>", 1), ("<section><h3>Method</h3>", 1), ("<p>{c}</p></section></main>", 1), ("<div class=footer>{o}</div>", 0)],
    [("<div>{n}</div>", 0), ("<article><p>{e}</p>", 1), ("<p>{q}</p>", 1), ("<p>{g}</p>", 1), ("<p>{d}</p></article>", 1), ("<div>{m}</div>", 0)],
    # no such element
    [("<div class=menu><a href=1>Home</a></div>", 0), ("<h1>Fog over the islands</h1>", 1), ("<p>{a}</p>", 1), ("<p>{e}</p>", 1), ("<p>{b}</p>", 1), ("<div class=footer>{m}</div>", 0)],
    [("<div><a href=1>Home</a> <a href=2>News</a> <a href=3>Sport</a></div>", 0), ("<h2>{d}</h2>", 1), ("<p>{f}</p>", 1), ("<p>{g}</p>", 1), ("<p>{c} <a href=4>More</a></p>", 1), ("<div><a href=5>Next</a></div>", 0), ("<div><a href=6>Imprint</a> <a href=7>Contact</a></div>", 0)],
    [("<form id=wrap><div id=cookie-notice>{j}</div>", 0), ("<div class='content header-fixed'><h1>Wald</h1>", 1), ("<p>{h}</p>", 1), ("<p>{h} {i}</p>", 1), ("<p>{d}</p></div>", 1), ("<div class=sidebar>{o}</div></form>", 0)],
    [("<ul>", None), *_MENU, ("</ul><p>{b}</p>", 1), ("<p>{d}</p>", 1), ("<p>{a}</p>", 1), ("<div class=comments><p>{l}</p>", 0), ("<p>{a}</p></div>", 0), ("<footer>{m}</footer>", 0)],
    [("<p><a href=1>One</a></p>", 0), ("<p><a href=2>Two and three</a></p>", 0), ("<p>{f}</p>", 1), ("<p>{q}</p>", 1), ("<p>{a} {b}</p>", 1), ("<p>{e}</p>", 1), ("<p><a href=3>Four</a></p>", 0)],
    [("<nav>{q}</nav>", 0), ("<p>{c}</p>", 1), ("<p>{g}</p>", 1), ("<footer>{o}</footer>", 0)],
    [("<nav>{a}</nav>", 0), ("<div>{b}</div>", 1), ("<div class=ad>{n}</div>", 0), ("<div>{f}</div>", 1), ("<aside>{o}</aside>", 0)],
    [("<p>{g}</p>", 1), ("<p>{f}</p>", 1)],
    [("<p>{e}</p>", 1)],
    [("<p>{q}</p>", 1), ("<p>{d}</p>", 1), ("<p>{e}</p>", 1)],
    [("<nav><a href=1>only</a> <a href=2>a menu</a></nav>", 0)],
    [("<div><a href=1>Only one link here</a></div>", 0)],
    [("<table><tr><td><a href=1>Home</a></td><td>", 0), ("<h1>Bread</h1>", 1), ("<p>{c}</p>", 1), ("<p>{c} {g}</p>", 1), ("<div class='widget popup'>{k}</div></td></tr></table>", 0)],
    [("<div class=header>The Valley Post</div>", 0), ("<div id=main><p>{i}</p>", 1), ("<p><b>{d}</b></p>", 1), ("<p>{a}</p></div>", 1), ("<div id=related><a href=1>{q}</a></div>", 0), ("<div class=notice>{j}</div>", 0)],
    [("<div><p>{h}</p>", 1), ("<div class=ad>{d}</div>", 0), ("<p>{h}</p></div>", 1), ("<form><p>{k}</p></form>", 0)],
    [("<header><a href=/>The Post</a></header>", 0), ("<h1>{q}</h1>", 1), ("<p class=lead>{d}</p>", 1), ("<p class=social-history>{b}</p>", 1), ("<p>{f}</p>", 1), ("<footer>{e}</footer>", 0)],
    [("<nav>{q}</nav>", 0), ("<article><div class=post-header><h1>{d}</h1>", 1), ("<p class=social-life>{e}</p></div>", 1), ("<h2>Parts</h2>", 1), ("<ul><li><a href=1>Part one</a>", 1), ("<li><a href=2>Part two of the story</a>", 1), ("<li>Part three</ul>", 1), ("<p>{a}</p>", 1), ("<h2>One</h2>", 1), ("<p>{e}</p>", 1), ("<p><a href=3>See</a></p>", 1), ("<p>{q}</p>", 1), ("<div class=page-footer>{m}</div></article>", 0)],
    [("<div class=notice>{e}</div>", 0), ("<div>{d}</div>", 0), ("<main><h1>Fog</h1>", 1), ("<p class=header-note>{p}</p>", 1), ("<p><a href=1>Map</a></p>", 1), ("<p>{e}</p>", 1), ("<p>{f}</p>", 1), ("<p>{e}</p>", 1), ("<dl><dt>Year", 1), ("<dd>1961", 1), ("<dt>Place", 1), ("<dd><a href=2>The valley</a></dl>", 1), ("<p>{b} {a}</p>", 1), ("<p>Sources</p>", 1), ("<ol><li><a href=3>A long title of a source that was read for this</a>", 1), ("<li><a href=4>Another</a></ol></main>", 1), ("<div><a href=5>Up</a></div>", 0)],
    [("<div id=top><a href=1>Skip</a></div>", 0), ("<article><header class=entry-header><h1>{q}</h1>", 1), ("<div>{p}</div>", 1), ("<div><a href=2>Anna Berg</a></div></header>", 1), ("<p class='intro related-study'>{c}</p>", 1), ("<h3>Note</h3>", 1), ("<p>{d}</p>", 1), ("<h3>Links</h3>", 1), ("<p><a href=3>One</a></p>", 1), ("<p><a href=4>Two</a></p>", 1), ("<p>{h}</p>", 1), ("<p class=ad-hoc>{g}</p></article>", 1), ("<p>{e}</p>", 0), ("<p>{d}</p>", 0)],
    [("<header><p>{d}</p></header>", 0), ("<div>{g}</div>", 0), ("<article class=comment-policy><h1>{d}</h1>", 1), ("<p>{d}</p>", 1), ("<p>{q}</p>", 1), ("<p>{e}</p></article>", 1), ("<p>{f}</p>", 0)],
    # neighbours tell plain words in menus from short paragraphs, and links in the text from menus
    [("<div><a href=1>Home</a></div>", 0), ("<div>Sections</div>", 0), ("<div><a href=2>Sport</a></div>", 0), ("<div>More</div>", 0), ("<div><a href=3>Weather</a></div>", 0), ("<p>{a}</p>", 1), ("<p>{e}</p>", 1), ("<p>{b}</p>", 1)],
    [("<p>{f}</p>", 1), ("<p><a href=1>{g}</a></p>", 1), ("<p>{c}</p>", 1), ("<p>{a}</p>", 1), ("<div><a href=2>About us</a></div>", 0), ("<div>Follow us</div>", 0), ("<div><a href=3>Mail</a></div>", 0)],
    [("<header>The Valley Post</header>", 0), ("<p>{b}</p>", 1), ("<p>See also <a href=1>the first report on the bridge</a></p>", 1), ("<p>{f}</p>", 1), ("<div><a href=2>Back</a></div>", 0)],
    [("<header><span>{q}</span></header>", 0), ("<ul><li><a href=1>Home</a>", 0), ("<li>Here", 0), ("<li><a href=2>Contact</a></ul>", 0), ("<h1>Bread</h1>", 1), ("<p>{c}</p>", 1), ("<ul><li>{d}", 1), ("<li>{e}</ul>", 1), ("<p>{h}</p>", 1)],
    [("<p>{i}</p>", 1), ("<p>{h}</p>", 1), ("<p><a href=1>Le marché en images, une longue suite de vues</a></p>", 1), ("<p>{f}</p>", 1), ("<div>Tags</div>", 0), ("<div><a href=2>market</a></div>", 0), ("<div><a href=3>town</a></div>", 0)],
    [("<div><a href=1>A</a> <a href=2>B</a></div>", 0), ("<div>Menu</div>", 0), ("<div><a href=3>C</a></div>", 0), ("<p>{q}</p>", 1), ("<p>{a}</p>", 1), ("<p>{g}</p>", 1), ("<p>{i}</p>", 1)],
]


def labelled_pages() -> list[tuple[str, list[bool]]]:
    """(html, keep of each block) of all pages."""
    return [("".join(h for h, _ in page).format(**SENTENCES), [bool(k) for _, k in page if k is not None]) for page in _PAGES]
