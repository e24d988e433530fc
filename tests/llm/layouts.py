"""Pages for tests, built another way than those that training composes: sites with templates of their own."""

import random

WORDS = "river stone window market letter garden winter bridge story paper silver morning thunder candle harbour meadow engine mirror forest island".split()


def prose(r, low=6, high=22):
    return " ".join(r.choice(WORDS) for _ in range(r.randint(low, high))).capitalize() + r.choice([".", ".", ".", "?", "!"])


def paragraph(r):
    return " ".join(prose(r) for _ in range(r.randint(1, 5)))


def phrase(r):
    return " ".join(r.choice(WORDS) for _ in range(r.randint(1, 4))).title()


def links(r, between):
    return between.join(f'<a href="/{r.choice(WORDS)}">{phrase(r)}</a>' for _ in range(r.randint(3, 8)))


def article(r, main):
    """Title, paragraphs, now and then a subheading, a list or a quotation; short paragraphs anywhere, the end included."""
    def add(tag, text):
        main.append(text)
        return f"<{tag}>{text}</{tag}>"

    out = [add("h1", phrase(r) + " " + phrase(r))]
    for k in range(r.randint(2, 9)):
        x = r.random()
        out.append(
            add("p", paragraph(r)) if x < 0.75 else add("h2", phrase(r)) if x < 0.83 else add("p", prose(r, 2, 4)) if x < 0.9
            else "<ul>" + "".join(add("li", prose(r, 3, 9)) for _ in range(3)) + "</ul>" if x < 0.96 else f"<blockquote>{add('p', paragraph(r))}</blockquote>"
        )
        if r.random() < 0.05:
            out.append(f'<div class="ad-slot"><p>{paragraph(r)}</p></div>')
    if r.random() < 0.3:
        out.append(f'<div class="comments"><p>{phrase(r)}</p><p>{paragraph(r)}</p></div>')
        out.append(add("p", prose(r, 2, 4)))
    return "".join(out)


def blog(r, main):
    return (
        f'<body><div id="masthead"><a href="/">{phrase(r)}</a></div><div class="main-menu">{links(r, " ")}</div>'
        f'<div class="post-body">{article(r, main)}</div><div class="sidebar-right"><h3>{phrase(r)}</h3><ul><li>{links(r, "</li><li>")}</li></ul></div>'
        f'<div id="comments-area"><h3>{phrase(r)}</h3><div class="comment"><p>{paragraph(r)}</p></div></div><div id="footer"><p>&copy; {phrase(r)}</p></div></body>'
    )


def news(r, main):
    return (
        f'<body><header><h2>{phrase(r)}</h2><nav><ul><li>{links(r, "</li><li>")}</li></ul></nav></header>'
        f'<div class="cookie-banner"><p>{prose(r)}</p><button>{phrase(r)}</button></div><main><article>{article(r, main)}</article>'
        f"<aside><h3>{phrase(r)}</h3><p>{paragraph(r)}</p></aside></main><footer><p>{prose(r)}</p>{links(r, ' | ')}</footer></body>"
    )


def plain(r, main):
    return f'<body><div class="row"><div class="col-4"><ul><li>{links(r, "</li><li>")}</li></ul></div><div class="col-8">{article(r, main)}</div></div></body>'


def table(r, main):
    return f"<body><table><tr><td>{links(r, '<br>')}</td><td>{article(r, main)}</td></tr><tr><td>&copy; {phrase(r)} {links(r, ' ')}</td></tr></table></body>"


def bare(r, main):
    return f"<body>{article(r, main)}</body>"


SITES = [blog, news, plain, table, bare]


def page(r: random.Random, k: int):
    main = []
    return SITES[k % len(SITES)](r, main), main
