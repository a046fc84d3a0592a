"""Fixed values that results depend on: patterns, word lists and tables."""

# Patterns of the global suppression gates.
LISTING_SUPPRESS = [
    r"\bcheck out\b.{0,60}\b(?:ebay|amazon|etsy)\b",
    r"\bvia @?(?:ebay|amazon|etsy)\b",
    r"\b(?:ebay|etsy)\b.{0,40}\bfor sale\b",
    r"\bjust saw this on amazon\b",
]
PERSONAL_FINANCE_SUPPRESS = [
    r"\bmy (?:loan|debt|payment|bill|car|house|phone)\b",
    r"\$[\d,]+\b.{0,30}\bto fix\b",
    r"\bcosts?\b.{0,20}\$[\d,]+\b.{0,20}\bto fix\b",
    r"\bstill paying (?:it|them) off\b",
]
PERSONAL_INTENT_SUPPRESS = [
    r"\bmy plan is\b.{0,40}\bnot\b.{0,20}\bbuy\b",
    r"\bi (?:will be |am going to |plan to )?(?:picking up|pick up) my copy\b",
    r"\bwill not bow\b",
    r"\bwe will not bow\b",
    r"\bi won't be buying\b",
    r"\bnot (?:not )?buy any company who\b",
    r"\bwho discriminates\b",
]
BOYCOTT_SUPPRESS = [
    r"\bboycott\w*\b",
    r"\bdivest\b.{0,40}\bpipeline\b",
    r"\btell @?\w+ to (?:stop|divest|pull)\b",
    r"\bsign the petition\b",
    r"\btake action\b.{0,40}\btell @?\w+\b",
]
PERSONAL_CREDIT_SUPPRESS = [
    r"\b(?:i|we|you|he|she|they) (?:might|may|could|will|would) go bankrupt\b",
    r"\bmight go bankrupt because of shoddy\b",
    r"\bboycott\w*\b.{0,40}\bbankruptcy\b",
    r"\bshoddy workmanship\b",
    r"\bcustomer (?:complaint|service|support)\b",
    r"\brepay\b.{0,20}\$[\d,]+\b",
]
OPINION_SUPPRESS = [
    r"\b(?:i think|i believe|in my opinion|imo|imho)\b",
    r"\b(?:will|might|could|may|should|probably) (?:rise|fall|drop|surge|crash|go up|go down)\b",
    r"\bbetting on\b",
    r"\bmade bets?\b",
    r"\b(?:buy|sell) (?:this|the) stock\b",
    r"\bhow low .{0,30}stock will drop\b",
]

# Patterns that show a material event, by event type, in order of precedence.
RULES = {
    "Merger & Acquisition": [
        r"\b(?:plans? to |agrees? to |agreed to |has )?acquire[sd]?\b",
        r"\bacquisition\b",
        r"\bmerger\b",
        r"\b#merger\w*",
        r"\bmerge[sd]?\b",
        r"\btakeover\b",
        r"\bbid (?:for|to acquire)\b",
        r"\bmakes? .{0,20}bid\b",
        r"\b(?:offers?|offered) (?:to )?(?:buy|acquire)\b",
        r"\basset deal\b",
        r"\bdeal (?:to acquire|to buy)\b",
        r"\b(?:purchase|purchased) (?:of|stake in)\b",
        r"\b\d+(?:\.\d+)?[\s]*%[\s]*stake\b",
        r"\bstake in [A-Z][A-Za-z0-9&.\- ]{1,60}\b",
        r"\bplans to acquire\b",
        r"\bbuys\b.{0,80}\b(?:to (?:create|build|expand)|cloud|platform|service|api)\b",
        r"\bbought \$\d+(?:\.\d+)?\s*(?:billion|million|bn|m)\b.{0,40}(?:stock|shares?)\b",
        r"\b\$\d+(?:\.\d+)?\s*(?:billion|million|bn|m)\b.{0,40}\b(?:acquisition|stake|bid|deal|merger)\b",
    ],
    "Regulatory / Legal": [
        r"\bfined\b",
        r"\bfine of\b",
        r"\bpenalt(?:y|ies)\b",
        r"\bregulatory (?:action|approval|probe|investigation|fine|block|reject)\b",
        r"\bregulator(?:y|s)?\b.{0,40}\b(?:probe|investigat|fine|penalt|approv|reject|block)\b",
        r"\b(?:SEC|FTC|DOJ|FCA|CFTC|FINRA|OCC|CFPB|FAA|NTSB|DOT|EPA|FDA)\b",
        r"\bground(?:ing|ed|s)?\b",
        r"\bantitrust\b",
        r"\blawsuit\b",
        r"\bclass[- ]action\b",
        r"\bsued\b",
        r"\bsues\b",
        r"\bsettlement\b",
        r"\bsettled with\b",
        r"\bcharged with\b",
        r"\bAML controls? failings?\b",
        r"\bpay \$[\d,]+\w*\b.{0,40}\bregulator\b",
    ],
    "Corporate / Earnings": [
        r"\bearnings?\b",
        r"\bquarterly results?\b",
        r"\bannual results?\b",
        r"\brevenue (?:rose|fell|grew|declined|missed|beat)\b",
        r"\bprofit (?:rose|fell|grew|declined|missed|beat)\b",
        r"\b(?:sales|revenue|profit|earnings) (?:beat|missed) (?:estimates?|expectations?)\b",
        r"\bguidance\b",
        r"\bprofit warning\b",
        r"\breports? (?:record|quarterly|annual) (?:sales|revenue|profit|loss)\b",
        r"\bIPO\b",
        r"\binitial public offering\b",
        r"\blayoffs?\b",
        r"\bjob cuts?\b",
        r"\bgrowing faster than @?\w+\b",
    ],
    "Macroeconomic": [
        r"\binflation\b",
        r"\binterest rates?\b",
        r"\brate (?:hike|cut|decision|change)\b",
        r"\bcentral bank\b",
        r"\bfederal reserve\b",
        r"\bthe Fed\b",
        r"\bGDP\b",
        r"\bunemployment\b",
        r"\bjobs? report\b",
        r"\bconsumer price index\b",
        r"\bCPI\b",
        r"\bproducer price index\b",
        r"\bPPI\b",
        r"\bmonetary policy\b",
        r"\bfiscal policy\b",
        r"\btax reform\b",
        r"\btariffs?\b",
        r"\btrade war\b",
        r"\brecession\b",
        r"\bkeep rates steady\b",
        r"\bawaits? .{0,30}economic plan\b",
    ],
    "Commodity / Supply Chain": [
        r"\bOPEC\b",
        r"\bcrude oil\b",
        r"\boil prices?\b",
        r"\boil output\b",
        r"\bnatural gas prices?\b",
        r"\bcommodity prices?\b",
        r"\bcommodity market\b",
        r"\bcrop (?:shortage|failure|production)\b",
        r"\bgrain prices?\b",
        r"\bsupply chain disruption\b",
        r"\bsupply disruption\b",
        r"\bshipping disruption\b",
        r"\bport disruption\b",
        r"\bproduction halt\b",
        r"\braw material shortage\b",
        r"\bsemiconductor shortage\b",
        r"\boutput cuts?\b",
    ],
    "Product / Technology": [
        r"\b(?:new )?product launch\b",
        r"\bunveiled\b",
        r"\brecall(?:ed)?\b",
        r"\bservice outage\b",
        r"\bsystem outage\b",
        r"\bnetwork outage\b",
        r"\boutage\b",
        r"\bservice disruption\b",
        r"\btechnology disruption\b",
        r"\bcyberattack\b",
        r"\bcyber attack\b",
        r"\bdata breach\b",
        r"\bsecurity breach\b",
        r"\blaunched\b.{0,40}\b(?:platform|service|product|solution|cloud|app)\b",
        r"\bplans to release\b.{0,40}\b(?:headset|device|platform|product)\b",
    ],
    "Market / Liquidity": [
        r"\btrading halt\b",
        r"\bshares? (?:fell|rose|surged|plunged|rallied|slumped|tumbled)\b",
        r"\bstock (?:fell|rose|surged|plunged|rallied|slumped|tumbled)\b",
        r"\bmarket (?:selloff|rally|crash|plunge)\b",
        r"\bwall street (?:falls?|rises?)\b",
        r"\bliquidity crisis\b",
        r"\bvaluation (?:cut|reduced|raised|slashed)\b",
        r"\bprice target (?:cut|raised|lowered)\b",
        r"\bshares? (?:halted|suspended)\b",
        r"\bcredit spreads?\b",
        r"\bfighting back against .{0,30}tax\b",
        r"\bborder tax\b",
    ],
    "Credit Event": [
        r"\bfiled for bankruptcy\b",
        r"\bfiled bankruptcy\b",
        r"\bdeclared bankruptcy\b",
        r"\bentered bankruptcy(?: protection)?\b",
        r"\bbankruptcy protection\b",
        r"\bchapter\s+(?:7|11|15)\b",
        r"\bdefault(?:ed|s)? on (?:its |the )?(?:debt|loan|bond|payment)\b",
        r"\bmissed (?:a |its |the )?(?:debt|loan|bond|interest) payment\b",
        r"\bdebt restructuring\b",
        r"\brestructur(?:e|ing|ed) (?:its |the )?(?:debt|loans?)\b",
        r"\bcovenant breach\b",
        r"\bbond default\b",
        r"\bcredit (?:downgrade|rating (?:cut|lowered))\b",
        r"\bdowngrad(?:ed|e) (?:its |the )?credit\b",
        r"\binsolvency\b",
        r"\binsolvent\b",
    ],
    "Geopolitical": [
        r"\bmissiles?\b",
        r"\bairstrike\b",
        r"\bair strike\b",
        r"\binvasion\b",
        r"\bmilitary (?:attack|strike|action|operation|conflict)\b",
        r"\barmed conflict\b",
        r"\bceasefire\b",
        r"\bsanctions?\b",
        r"\bdiplomatic (?:crisis|dispute|tensions?)\b",
        r"\bembargo\b",
        r"\bgeopolitical tensions?\b",
        r"\bcoup\b",
        r"\bsafe zones?\b",
        r"\btravel ban\b",
        r"\bimmigration order\b",
        r"\bexecutive order\b",
        r"\bappoints? .{0,40}director\b",
    ],
}

# Patterns that suppress one event type.
TYPE_SUPPRESS = {
    "Merger & Acquisition": [
        r"\beasy acquisition\b",
        r"\b(?:knowledge|skill|language|habit|taste) acquisition\b",
        r"\bacquired a (?:taste|skill|habit|love)\b",
        r"\b(?:car|vehicle|house|home|property) acquisition\b",
        r"\bbuying a (?:car|house|home|ring|watch)\b",
        r"\bnot (?:not )?buy any company who\b",
    ],
    "Credit Event": [
        r"\b(?:i|we|you|he|she|they) (?:might|may|could|will|would) go bankrupt\b",
        r"\bboycott\w*\b.{0,40}\bbankruptcy\b",
        r"\bshoddy workmanship\b",
        r"\bcustomer (?:complaint|service|support)\b",
        r"\brepay\b.{0,20}\$[\d,]+\b",
    ],
    "Commodity / Supply Chain": [
        r"\b(?:gold|silver)\s+(?:ring|necklace|earrings?|bracelet|jewelry)\b",
        r"\bjewelry\b",
        r"\bcollectible\b",
    ],
    "Product / Technology": [
        r"\bcustomer (?:complaint|service|support)\b",
        r"\b(?:coupon|discount|sale price|buy now|shopping cart)\b",
    ],
    "Market / Liquidity": [
        r"\b(?:will|might|could|may) (?:rise|fall|drop|surge|break out|crash)\b",
        r"\bbetting on\b",
        r"\bmade bets?\b",
        r"\b(?:buy|sell) (?:this|the) stock\b",
        r"\bhow low .{0,30}stock will drop\b",
    ],
    "Geopolitical": [
        r"\byour hatred\b",
        r"\b2 great nations embracing\b",
    ],
}

# Terms of the credit guard.
STRONG_TERMS = [
    r"\bdefault(?:s|ed)?\b",
    r"\bbankrupt(?:cy)?\b",
    r"\binsolven(?:cy|t)\b",
    r"\bdebt restructuring\b",
    r"\bmissed payment\b",
    r"\bcovenant breach\b",
    r"\b(?:credit|rating) downgrade\b",
    r"\bdebt distress\b",
    r"\bbond default\b",
    r"\bloan default\b",
]
WEAK_CONTEXTS = [
    r"\bdefault (?:browser|setting|password|option|app|theme)\b",
    r"\bdefault(?:ly)?\b",
]

# Reason names of the suppressed types.
SUPPRESSED = {"Merger & Acquisition": "ma_suppressed", "Credit Event": "credit_suppressed", "Commodity / Supply Chain": "commodity_suppressed", "Product / Technology": "product_suppressed", "Market / Liquidity": "market_suppressed", "Geopolitical": "geo_suppressed"}

# Severity of an event type; unknown types count 0.25, empty ones 0.
SEVERITY = {"Credit Event": 1.0, "Geopolitical": 0.9, "Macroeconomic": 0.85, "Merger & Acquisition": 0.8, "Regulatory / Legal": 0.75, "Corporate / Earnings": 0.7, "Commodity / Supply Chain": 0.7, "Market / Liquidity": 0.65, "Product / Technology": 0.5, "Other / Unclear": 0.3}

# Shock rules (rule, event type, scope, PD, LGD, bond price, equity price).
SHOCKS = [
    ("RULE-CREDIT-01", "Credit Event", "ENTITY", 0.15, 0.15, -0.20, -0.40),
    ("RULE-GEO-01", "Geopolitical", "GEOGRAPHY", 0.05, 0.05, -0.10, -0.15),
    ("RULE-MACRO-01", "Macroeconomic", "BROAD_MARKET", 0.04, 0.03, -0.08, -0.12),
    ("RULE-MA-01", "Merger & Acquisition", "ENTITY", 0.02, 0.01, -0.05, -0.20),
    ("RULE-REG-01", "Regulatory / Legal", "ENTITY", 0.04, 0.03, -0.08, -0.15),
    ("RULE-EARN-01", "Corporate / Earnings", "ENTITY", 0.03, 0.02, -0.06, -0.15),
    ("RULE-PROD-01", "Product / Technology", "ENTITY", 0.01, 0.005, -0.03, -0.10),
    ("RULE-COMM-01", "Commodity / Supply Chain", "SECTOR", 0.04, 0.04, -0.07, -0.10),
    ("RULE-MLIQ-01", "Market / Liquidity", "BROAD_MARKET", 0.03, 0.02, -0.10, -0.12),
    ("RULE-OTHER-01", "Other / Unclear", "ENTITY", 0.01, 0.005, -0.02, -0.05),
    ("RULE-NONE-01", "NO_EVENT", "NONE", 0.0, 0.0, 0.0, 0.0),
]

# Which shocks an asset class takes (PD and LGD, bond price, equity price).
CAPABLE = {"Corporate Loan": (True, False, False), "Revolving Credit Facility": (True, False, False), "Corporate Bond": (True, True, False), "Equity": (False, False, True)}

# Financial keywords and trusted domains.
KEYWORDS = ["merger", "acquisition", "acquire", "stake", "buyout", "bankruptcy", "chapter 11", "sec", "earnings", "revenue", "guidance", "profit", "lawsuit", "sues", "antitrust", "fda", "dividend", "layoff", "restructuring", "stock", "shares", "bond", "yield", "interest", "minority"]
DOMAINS = ["reuters.com", "bloomberg.com", "wsj.com", "ft.com", "cnbc.com", "marketwatch.com", "sec.gov", "prnewswire.com", "businesswire.com", "barrons.com"]
THEMES = ["ECON_", "CRISISLEX_", "TAX_FNCACT"]

# Event types that may share a cluster.
COMPATIBLE = {
    "Credit Event": ["Market / Liquidity", "Corporate / Earnings"],
    "Geopolitical": ["Macroeconomic", "Regulatory / Legal", "Commodity / Supply Chain"],
    "Macroeconomic": ["Geopolitical", "Regulatory / Legal", "Corporate / Earnings", "Commodity / Supply Chain", "Market / Liquidity"],
    "Merger & Acquisition": ["Corporate / Earnings"],
    "Regulatory / Legal": ["Geopolitical", "Macroeconomic", "Corporate / Earnings"],
    "Corporate / Earnings": ["Macroeconomic", "Merger & Acquisition", "Regulatory / Legal", "Product / Technology", "Credit Event"],
    "Product / Technology": ["Corporate / Earnings"],
    "Commodity / Supply Chain": ["Macroeconomic", "Geopolitical"],
    "Market / Liquidity": ["Macroeconomic", "Credit Event"],
}

# Signs of a deal that outweigh a conditional framing.
DEAL_SIGN = [r"\$[\d,.]+\s*(?:billion|million|bn|m)\b", r"\b\d+(?:\.\d+)?[\s]*%[\s]*(?:stake|share)", r"#merger\w*"]
# Words that show a person or a concept where a company's name stands, for the guard and for the offline guard.
GUARD_WORDS = {"ford": ["christine ", "rob ", "doug ", "tom "], "disney": ["walt disney"], "visa": ["f-1", "f1", "h1b", "h-1b", "tourist", "travel"]}
OFFLINE_WORDS = {"ford": ["christine", "rob ", "doug "], "disney": ["walt disney"], "visa": ["f-1", "f1", "h1b"]}
# Spellings of event types.
SPELLINGS = {
    "merger & acquisition": "Merger & Acquisition",
    "merger &amp; acquisition": "Merger & Acquisition",
    "regulatory / legal": "Regulatory / Legal",
    "regulatory/legal": "Regulatory / Legal",
    "corporate / earnings": "Corporate / Earnings",
    "corporate/earnings": "Corporate / Earnings",
    "commodity / supply chain": "Commodity / Supply Chain",
    "commodity/supply chain": "Commodity / Supply Chain",
    "market / liquidity": "Market / Liquidity",
    "market/liquidity": "Market / Liquidity",
    "product / technology": "Product / Technology",
    "product/technology": "Product / Technology",
    "credit event": "Credit Event",
    "geopolitical": "Geopolitical",
    "macroeconomic": "Macroeconomic",
}
# Funds that stand for sectors.
SECTOR_FUNDS = {
    "technology": "XLK",
    "financials": "XLF",
    "healthcare": "XLV",
    "consumer discretionary": "XLY",
    "consumer staples": "XLP",
    "energy": "XLE",
    "utilities": "XLU",
    "real estate": "XLRE",
    "materials": "XLB",
    "industrials": "XLI",
    "communication services": "XLC",
    "communications": "XLC",
    "info tech": "XLK",
    "information technology": "XLK",
    "health care": "XLV",
    "cons disc": "XLY",
    "cons staples": "XLP",
}
# Categories of the credit lexicon audit.
CREDIT_AUDIT = {
    "default": [r"\bdefaulted\b", r"\bdefaults?\b", r"\bdefault\b"],
    "bankruptcy": [r"\bfiled for bankruptcy\b", r"\bfiled bankruptcy\b", r"\bdeclared bankruptcy\b", r"\bentered bankruptcy\b", r"\bbankruptcy protection\b", r"\bchapter\s+(?:7|11|15)\b"],
    "debt_restructuring": [r"\bdebt restructuring\b", r"\brestructuring (?:its |the )?debt\b", r"\brestructure (?:its |the )?debt\b"],
    "insolvency": [r"\binsolvency\b", r"\binsolvent\b"],
    "credit_rating": [r"\bcredit rating\b", r"\bcredit downgrade\b", r"\bcredit downgraded\b", r"\brating downgrade\b", r"\brating downgraded\b"],
    "bond_default": [r"\bbond default\b", r"\bdefault(?:ed)? on .*bond\b", r"\bdefault(?:ed)? on .*debt\b", r"\bdefault(?:ed)? on .*loan\b"],
    "missed_payment": [r"\bmissed (?:loan|debt|bond|interest) payments?\b", r"\bmissed payments?\b", r"\bmissed .*payment\b"],
    "covenant": [r"\bcovenant breach\b", r"\bdebt covenant\b"],
}
# Names for which the naive audit assumes a collision, and columns that leak the future.
COLLIDING = ["visa", "ford", "disney", "mac", "chase"]
# Publishers, which are no entities, and company suffixes at the end of a name.
PUBLISHERS = ["reuters", "cnbc", "wsj", "cnn", "bloomberg", "ap", "associated press", "fox news", "ft", "financial times", "nytimes"]
SUFFIXES = ["inc", "corp", "corporation", "llc", "plc", "ltd", "company", "co"]

# Contexts in which a credit word means little, and anchors that tie it to a company.
WEAK_CREDIT = [r"\bdefault (?:ip|app|setting|password|browser|search)\b", r"\bdefault(?:ly)?\b", r"\bmorally bankrupt\b", r"\b(?:i|we|you|they|he|she) .*go bankrupt\b", r"\bboycott.*bankrupt", r"\b(?:car|house|personal|student) .*bankrupt", r"\bchapter 7.*eBay\b"]
CREDIT_ANCHORS = [
    r"\b(?:company|bank|lender|borrower|firm|corporation|corp|fund|issuer)\b", r"\b(?:debt|loan|bond|bonds|credit|rating|payment|financing)\b", r"\b(?:revenue|earnings|balance sheet|liabilities|capital)\b", r"\b(?:Reuters|Bloomberg|CNBC|WSJ)\b",
    r"@\b(?:GoldmanSachs|MorganStanley|DeutscheBank|JPMorgan|WellsFargo|Citi|BankofAmerica)\b",
]
