import hashlib
import random
import re
import time

from quarry.llm.chat import chat_digest, escaped, format_chat, read_chat, unescaped
from quarry.llm.pages import extract_main_text, main_blocks
from quarry.llm.queries import RULES
from quarry.llm.urls import DEFAULT_PATTERNS, RuleIndex, filter_urls, host_rule
from quarry.session import ship_package

URLS = [
    None,
    "",
    "no scheme.com/en/",
    "http://www.Example.COM/en/x?q#f",
    "http://example.com/en/",
    "http://example.com/enx",
    "http://notexample.com/en/",
    "https://a.b.net/es/1",
    "https://net/fr/",
    "http://x.org/adult/1",
    "http://x.org/adults/1",
    "http://com",
    "http://com/",
    "a://b://c/d",
    "http://sub.example.com/EN/x",
    "http://casino.com/x",
]


def plain_verdict(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host, path = re.match(r"([^/?#]*)([^?#]*)", rest).groups()
    host = host.encode().lower().decode()
    fitting = [
        (len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    if fitting:
        return host, path, max(fitting)[1], max(fitting)[2]
    words = set(re.findall("[a-z0-9]+", f"{host} {path}".lower()))
    bad = any(rule.tokens[0] in words for rule in DEFAULT_PATTERNS)
    return host, path, None, "block" if bad else "allow"


def test_urls(spark):
    ship_package(spark)
    pages = spark.createDataFrame([(k, u, "x", "y") for k, u in enumerate(URLS)], "page_id long, url string, host string, rule string")
    rules = [host_rule(*rule) for rule in RULES]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in filter_urls(pages, rules).collect()}
    assert got == {k: plain_verdict(u) for k, u in enumerate(URLS)}
    assert filter_urls(pages.limit(0), rules).count() == 0
    assert filter_urls(pages, [], patterns=[]).filter("verdict <> 'allow'").count() == 0


def test_only_rules_of_own_tokens_run():
    rules = [host_rule("block", f"host{k}.org", "/") for k in range(50)]
    index = RuleIndex(rules, {"org": 1000})
    assert all(len(rules) == 1 for rules in index.by_token.values()) and not index.always
    assert index.decide("a.host7.org", "/x") == ("host7.org/", "block")


def test_chat_reads_back(spark):
    parts = ["<", "|", "[", "INST", "]", "/", "s>", "\\", "é", "<|end|>", "\n", "<<SYS>>", "</s>"]
    chance = random.Random(2)
    rows = [(1, None, None, None, 0), (1, 1, "user", "", 0), (None, 1, "a<|text|>", "<\\\\|", 0), (1, 1, "user", "", 0)]
    for conv in range(2, 40):
        for turn in range(chance.randint(1, 8)):
            text = "".join(chance.choice(parts) for _ in range(chance.randint(0, 12)))
            rows.append((conv, turn, chance.choice(["user", "assistant", "system"]), text, 1))
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int")
    chats = format_chat(turns)
    got = {r.conv_id: r for r in chat_digest(chats).collect()}
    read = {r.conv_id: r for r in read_chat(chats).collect()}
    for conv in {r[0] for r in rows}:
        said = sorted((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == conv)
        assert [(t.role, t.text) for t in read[conv].turns] == [t[2:] for t in said]
        learnt = "".join(t[3] for t in said if t[2] == "assistant")
        whole = "".join(f"{t[2]}\n{t[3]}\n" for t in said)
        row = got[conv]
        assert row.n_turns == len(said) and row.loss_chars == len(learnt)
        assert row.loss_sha256 == hashlib.sha256(learnt.encode()).hexdigest()
        assert row.turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()
        # The mask lies over the formatted text itself.
        text, at = read[conv].formatted, 0
        for m, t in zip(read[conv].mask, said, strict=True):
            at += m.skip
            assert m.length == read[conv].turns[said.index(t)].length
            at += m.length
        assert at + len("<|end|>") == len(text) == row.formatted_chars
        # Neighbours of one role share a message.
        changes = sum(a[2] != b[2] for a, b in zip(said, said[1:])) + 1
        assert text.count("<|turn|>") == changes
    assert format_chat(turns.limit(0)).count() == 0
    trip = turns.select("text", unescaped(escaped(turns["text"])).alias("back"))
    assert trip.filter("not text <=> back").count() == 0


PARAGRAPH = "<p>A real paragraph, with words and a stop. And another sentence here, longer than most.</p>"
CLEAN = "A real paragraph, with words and a stop. And another sentence here, longer than most."
PAGES = {
    None: [],
    "": [],
    "<p": [],
    "plain <b>text</b>": ["plain text"],
    f"<html><body><header><h1>Site</h1></header><div class=menu><a href=x>Home</a></div><div id='content'><h2>T &amp; t</h2>"
    f"{PARAGRAPH}<p>Short</p>{PARAGRAPH}<ul><li>one<li>two</ul></div><div class='cookie-notice'>We use cookies, ok.</div>"
    "<div class=comments><p>Reader says, hello. This is long text, very long and much of it.</p></div><aside>Side, here.</aside>"
    "<form><p>Sign up, please.</p></form><footer>c</footer>": ["T & t", CLEAN, "Short", CLEAN, "one", "two"],
    "<body><script>var a='</p><p>no';</script><nav>menu</nav><div class='ad'>Buy, now. Really.</div><article><h1>Head</h1>"
    "<p><b>First line.<br><p>Second   line\n goes&nbsp;on.</p><p>Be.</p></article><footer>&copy; x</footer>": [
        "Head",
        "First line.",
        "Second line goes on.",
        "Be.",
    ],
    "<body><div class=x>Other sentence, here.</div><article><h1>Hi</h1><p>Be.</article>": ["Hi", "Be."],
    f"<body><div style='display:none'>hidden words, many.</div>{PARAGRAPH}a < b{PARAGRAPH}<p title=\"a>b\">end.": [CLEAN, "a < b", CLEAN, "end."],
}

STORY = [f"Paragraph {k} of the story, which is told at length, with commas, stops and marks. " * 5 for k in range(4)]
STORY = [" ".join(text.split()) for text in STORY]
TOLD = "".join(f"<p>{text}</p>" for text in STORY)
TEASER = "<article><h3>Read more</h3><p>A teaser of another page that says a little, and no more than that, to be read.</p></article>"


def test_articles_are_weak_evidence():
    assert main_blocks(f"<body><div class=story>{TOLD}</div><div class=more>{TEASER * 6}</div>") == STORY
    assert main_blocks(f"<body><main><div class=story>{TOLD}</div><div class=x><p>Short note.</p></div></main>") == STORY
    assert main_blocks(f"<body><div class=x><p>A note.</p></div><div class=story>{TOLD}</div>") == STORY
    assert main_blocks(f"<body><article><header><h1>Head</h1></header><div class=b>{TOLD}</div></article>") == ["Head", *STORY]


def test_boilerplate_words_are_evidence_only():
    for name in ("category-social", "category-legal", "tag-newsletter"):
        assert main_blocks(f"<body><article class='post {name}'>{TOLD}</article><footer>x</footer>") == STORY
    widget = "<div class='elementor-widget-container'>"
    assert main_blocks(f"<body>{widget}{TOLD}</div></body>") == STORY
    assert main_blocks(f"<body><div class='sidebar-right layout'><div class=ad>Buy, now.</div><div>{TOLD}</div></div>") == STORY
    assert main_blocks(f"<body><form id='aspnetForm'><div id=c>{TOLD}</div></form>") == STORY
    # More comments than text.
    comments = f"<div class=comments><article class=c>{TOLD}{TOLD}</article></div>"
    assert main_blocks(f"<body><article class=post>{TOLD}</article>{comments}") == STORY


def test_long_attributes():
    value = "x > y <p>no</p> " * 1000
    assert main_blocks(f"<body><div data-props=\"{value}\">{TOLD}</div>") == STORY
    assert main_blocks(f"<body><div title=\"open>{TOLD.replace(chr(34), '')}</div>") == STORY
    begin = time.monotonic()
    main_blocks("<a '\"x>y\"" * 40_000)
    assert time.monotonic() - begin < 30


def test_pages(spark):
    for page, blocks in PAGES.items():
        assert main_blocks(page or "") == blocks
    rows = [(k, "u", page, "clash") for k, page in enumerate(PAGES)] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = extract_main_text(pages).collect()
    assert len(got) == len(rows)
    for row in got:
        assert row.text == "\n\n".join(list(PAGES.values())[row.page_id]) and row.n_chars == len(row.text)
    assert extract_main_text(pages.limit(0)).count() == 0
