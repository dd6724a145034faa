"""The pages of test_models.test_what_is_not_the_article with their text, whose name a later list takes over there."""

import pytest

from pairloom.llm import html_main

PROSE = "A sentence of the usual kind, with a good many words in it, which goes on for a while and then ends as it should, so that it looks like any other text of the page."
OTHERS = [
    "<nav>{}</nav>", "<header><p>{}</p></header>", "<footer><p>{}</p></footer>", "<aside><p>{}</p></aside>", '<div class="sidebar"><p>{}</p></div>', '<div id="cookie-notice"><p>{}</p></div>', '<div class="notice">{}</div>', '<div class="ad">{}</div>',
    "<form><p>{}</p><button>Send</button></form>", '<section class="comments"><div class="comment"><p>{}</p></div><div class="comment"><p>{}</p></div></section>', '<div role="navigation"><p>{}</p></div>', "<div hidden><p>{}</p></div>", "<script>{}</script>", "<style>{}</style>",
]


@pytest.mark.parametrize("tags", [("<article>", "</article>"), ("<main>", "</main>"), ("<div>", "</div>")])
@pytest.mark.parametrize("other", OTHERS)
def test_what_is_not_the_article(tags, other):
    main = f"<h1>On rivers</h1><p>{PROSE}</p><p>So it is.</p><p>{PROSE} &amp; more.</p><ul><li>one</li><li>two</li></ul>"
    want = f"On rivers {PROSE} So it is. {PROSE} & more. one two"
    part = other.replace("{}", PROSE.replace("usual", "other"))
    for page in (f"<body>{part}{tags[0]}{main}{tags[1]}</body>", f"<body>{tags[0]}{main}{tags[1]}{part}</body>"):
        assert html_main.main_text(page)[0] == want
