"""Word lists and limits of the bundled policy."""

from __future__ import annotations


def _list(text: str) -> tuple[str, ...]:
    return tuple(part.strip() for part in text.replace("\n", " ").split("|") if part.strip())


SNIPPET = 200
FINDING_ID_DIGITS = 16

#: words before a colon that make a line prose rather than a key
NOT_KEYS = frozenset(
    _list(
        """caution | default | description | details | example | http | https | important | info | input | note | output
        | reference | result | returns | run | see | step | summary | tip | usage | warning"""
    )
)

DEFAULT_ALLOWED_DOMAINS = _list(
    """anthropic.com | bitbucket.org | developer.mozilla.org | docs.python.org | example.com | example.net | example.org
    | github.com | gitlab.com | img.shields.io | modelcontextprotocol.io | npmjs.com | openai.com | pypi.org
    | raw.githubusercontent.com | stackoverflow.com | wikipedia.org"""
)
LOCAL_HOSTS = _list("0.0.0.0 | 127.0.0.1 | ::1 | localhost")
RESERVED_HOSTS = tuple(f"{prefix}example.{end}" for prefix in ("", "www.") for end in ("com", "net", "org"))
LOCAL_ENDINGS = _list(".example | .internal | .invalid | .local | .localhost | .test")
SHORTENERS = _list(
    "bit.ly | buff.ly | cutt.ly | goo.gl | is.gd | lnkd.in | ow.ly | rb.gy | rebrand.ly | shorturl.at | t.co | tiny.cc | tinyurl.com"
)

NEGATIONS = tuple(x.replace("_", " ") for x in _list("no_ | not_ | without_ | don't need | doesn't require | not require | not needed | no need for"))

DESTRUCTIVE_TIER = _list("DELETE | DESTROY | DROP | FORCE | MERGE | PURGE | REMOVE")
WRITE_TIER = _list("CREATE | DISPATCH | MODIFY | PATCH | SEND | TRIGGER | UPDATE")
TOOL_PREFIXES = _list("RUBE_ | MCP_")
SERVICE_PREFIXES = _list(
    """ZENDESK | TWILIO | TELEGRAM | SUPABASE | STRIPE | SLACK | SHOPIFY | SENDGRID | SALESFORCE | OPENAI | NOTION
    | MAILCHIMP | LINEAR | JIRA | HUBSPOT | GOOGLE | GITLAB | GITHUB | DISCORD | AZURE | AWS | AIRTABLE"""
)

#: tier -> services in the order of search
SERVICES = {
    "high": _list(
        "gmail | outlook | stripe | paypal | braintree | square | salesforce | hubspot | bamboohr | workday | gusto | rippling | adp | zenefits | namely"
    ),
    "medium": _list("github | gitlab | bitbucket | slack | discord | teams | jira | linear | asana | notion | confluence | trello | monday | clickup | airtable"),
    "low": _list("weather | giphy | nasa | unsplash | wikipedia | wolfram | openweather"),
}
KEYWORDS = {
    "high": _list(
        """payment | credit card | social security | bank account | salary | medical | password | credential | billing | invoice
        | ssn | tax | payroll | health record | patient | diagnosis"""
    ),
    "medium": _list("private repository | private repo | direct message | private message | confidential | proprietary"),
}
WEAK_KEYWORDS = _list("internal | employee | personnel")
TIER_SCORES = {"high": 65, "medium": 40, "low": 15}
SERVICE_CATEGORIES = {
    service: category
    for category, services in {
        "communication/PII": "gmail | outlook",
        "financial": "stripe | paypal | braintree | square",
        "CRM/PII": "salesforce | hubspot",
        "HR/PII": "bamboohr | workday | gusto | rippling | adp | zenefits | namely",
        "source-code": "github | gitlab | bitbucket",
        "messaging": "slack | discord | teams",
        "project-management": "jira | linear | asana | trello | monday | clickup",
        "knowledge-base": "notion | confluence",
        "database": "airtable",
        "public-data": "weather | giphy | nasa | unsplash | wikipedia | wolfram | openweather",
    }.items()
    for service in _list(services)
}
KEYWORD_CATEGORIES = {
    keyword: category
    for category, keywords in {
        "financial": "bank account | billing | credit card | invoice | payment | payroll | tax",
        "medical/health": "diagnosis | health record | medical | patient",
        "PII": "credential | password | salary | social security | ssn",
    }.items()
    for keyword in _list(keywords)
}

SECRET_WORDS = _list("api_key | apikey | token | secret | password | credential | private_key | auth")
SECRET_REF_WORDS = _list("api_key | apikey | auth | credential | key | passwd | password | private | secret | token")
FRONT_MATTER_SKIP = _list("author | description | documentation | homepage | keywords | license | name | repository | tags | version")
SPOOFED_KEYS = _list("command | exec | name | requires | script | server | service | tool | tools")

HIDDEN_PHRASES = tuple(
    f"{verb} {rest}".strip()
    for verb, rests in (
        ("ignore", ("previous instructions", "all instructions")),
        ("disregard", ("instructions", "previous")),
        ("override", ("instructions", "previous")),
        ("inject", ("instructions",)),
        ("do not", ("reveal", "disclose")),
        ("exfiltrate", ("data", "information", "conversation", "history", "session", "credentials", "secrets", "the")),
        ("", _list("send data to | upload data to | send to http | post to http | forward data to")),
        ("bypass", ("security", "restrictions", "safety")),
        ("", _list("hidden instruction | system prompt override | you are now | pretend you are | act as if")),
        ("do not", ("mention", "tell", "say", "show", "log")),
        ("keep this", ("secret", "hidden")),
        ("never", ("mention", "reveal")),
        ("", ("secretly", "silently", "covertly")),
        ("without", ("telling", "informing", "the user knowing")),
    )
    for rest in rests
)
PAYLOAD_STRONG = tuple(p for p in HIDDEN_PHRASES if p.split()[0] in ("ignore", "disregard", "override", "inject", "upload", "bypass", "hidden", "system") or p in ("send data to", "exfiltrate data", "exfiltrate information"))
PAYLOAD_WEAK = tuple(
    p
    for p in HIDDEN_PHRASES
    if p.split()[0] in ("you", "pretend", "act", "keep", "never", "secretly", "covertly") or p in ("do not reveal", "do not disclose", "without telling", "without the user knowing")
)
FETCH_PHRASES = tuple(
    [f"{verb} and {act}" for verb in ("download", "fetch") for act in ("execute", "run")]
    + [f"{verb} {what} from" for verb, what in (("fetch", "config"), ("fetch", "configuration"), ("load", "instructions"), ("load", "config"), ("pull", "instructions"), ("pull", "config"), ("source", "instructions"), ("import", "instructions"))]
    + [*_list("execute from url | execute from remote | run script from | eval remote")]
    + [f"{tool} | {shell}" for tool in ("curl", "wget") for shell in ("sh", "bash")]
    + ["pipe to shell"]
)

ZERO_WIDTH = tuple(range(0x200B, 0x2010)) + tuple(range(0x2060, 0x2065))
BIDI_NAMES = dict(zip((*range(0x202A, 0x202F), *range(0x2066, 0x206A)), _list("LRE | RLE | PDF | LRO | RLO | LRI | RLI | FSI | PDI")))
CONFUSABLE_RANGES = ((0x0370, 0x04FF), (0x2100, 0x214F), (0xFF00, 0xFFEF))

PROFILES = {
    # name: (high severity from, medium severity from, least rule score in the aggregate, local hosts suppressed)
    "strict": (70, 40, 20, False),
    "balanced": (80, 50, 40, True),
    "audit": (70, 40, 101, True),
}
SEVERITY_RANK = {"low": 0, "medium": 1, "high": 2}
