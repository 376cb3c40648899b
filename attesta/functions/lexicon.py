"""Word lists, domains and patterns whose values are part of the query semantics."""

from __future__ import annotations

# Words left out of claims before matching.
CLAIM_STOP_WORDS = (
    "a an the in on of and for with to at by from is are was were be been being have has had do does did can could should would may might must that which who this "
    "these those it its as via using into through more most than or not no also both all any some show shows demonstrate demonstrates finding findings study paper"
).split()

# Words left out of a topic before matching, for general sources and for literature.
TOPIC_STOP_WORDS = (
    "a an the in on of and for with to at by from is are via using as system study paper while how what which into their this that over under between when"
).split()
LITERATURE_STOP_WORDS = "a an the in on of and for with to at by from is are via using as system study paper".split()

# Words left out of titles before their tokens are compared.
TITLE_STOP_WORDS = "a an the in on of and for with to at by from is are via using as".split()

# Words left out of queries that are too long.
QUERY_STOP_WORDS = (
    "a an the and or of for in on at to from by with about into through during is are was were what which how why investigate investigating explore exploring study "
    "studying understanding comparison comparing different various"
).split()

# Hosts that are never sources.
JUNK_DOMAINS = (
    "merriam-webster.com dictionary.cambridge.org vocabulary.com wiktionary.org thesaurus.com collinsdictionary.com dictionary.com definitions.net urbandictionary.com "
    "amazon.com amazon.co.uk amazon.in amazon.de ebay.com ebay.co.uk walmart.com homedepot.com lowes.com etsy.com alibaba.com aliexpress.com target.com bestbuy.com "
    "wayfair.com fandom.com wikia.com youtube.com youtu.be facebook.com twitter.com x.com instagram.com tiktok.com pinterest.com linkedin.com quora.com reddit.com "
    "stackexchange.com udemy.com coursera.org edx.org skillshare.com pluralsight.com ollama.com hostinger.com simplilearn.com vocal.media tutorialspoint.com "
    "javatpoint.com w3schools.com geeksforgeeks.org buzzfeed.com huffpost.com"
).split()
ADULT_HOST_PARTS = "xhamster pornhub xvideos xnxx redtube youporn chaturbate spankbang beeg tube8".split()

# Parts of titles and contents of pages that are no sources.
JUNK_TITLES = (
    "definition & meaning", "definition and meaning", "english meaning", "meaning & pronunciation", "how to use in a sentence", "synonyms & antonyms", "translation in",
    "shop through", "free shipping", "buy online", "for sale", "best price", "add to cart", "create a course", "| fandom", "wiki | fandom", "customer reviews",
    "deals & discounts", "lowest price", "free delivery", "in stock", "order now",
)
SHOP_CONTENTS = ("add to cart", "buy now", "free shipping on orders")
WIKI_SLUGS = "comparison error bias test definition overview survey chain network model system tool tools product products item items".split()

# Hosts of institutions and publishers.
TRUSTED_SUFFIXES = (".edu", ".gov", ".ac.uk", ".ac.in", ".gov.in", ".edu.au", ".ac.jp", ".mil", ".int", ".europa.eu")
TRUSTED_DOMAINS = (
    "arxiv.org doi.org nature.com science.org sciencedirect.com springer.com ieee.org acm.org nih.gov who.int nist.gov biorxiv.org medrxiv.org wiley.com "
    "tandfonline.com plos.org frontiersin.org mdpi.com openreview.net aclanthology.org jmlr.org owasp.org semanticscholar.org openalex.org "
    "pubmed.ncbi.nlm.nih.gov pmc.ncbi.nlm.nih.gov link.springer.com onlinelibrary.wiley.com bmj.com biomedcentral.com jamanetwork.com thelancet.com jstor.org cell.com "
    "cambridge.org oup.com academic.oup.com"
).split()

# What names a preprint server or a conference in a venue or address.
PREPRINT_WORDS = ("arxiv", "biorxiv", "medrxiv", "ssrn", "osf", "osti", "preprint", "working paper", "research square")
CONFERENCE_WORDS = ("proceedings", "conference", "workshop", "symposium", "ieee", "acm", "icml", "neurips", "cvpr", "emnlp", "aaai")

# Words of shops, and words that make a claim one of research.
COMMERCE = r"\b(amazon|home depot|ebay|walmart|price|purchase|shopping|buy|cart|discount|order online|shipping)\b"
RESEARCH_WORDS = (
    "model performance accuracy benchmark evaluation result error security code system algorithm dataset technology industry application effectiveness automation"
).split()

# Phrases in which a paper states what it found.
FINDING_CUES = (
    r"\b(we (propose|present|show|find|found|demonstrate|introduce|conclude|observe|evaluate)|our (results|findings|approach|framework|analysis|study)"
    r"|results (show|indicate|reveal|suggest)|this (paper|study|work) (proposes|presents|shows|finds|examines)|in conclusion|outperform\w*|significantly)\b"
)

# Headings a report has to have, and the first headings after its body, in the order in which they cut it.
SECTIONS = ("executive summary", "general research findings", "literature review", "critical analysis", "knowledge gaps", "recommendations", "conclusion")
BODY_ENDS = (
    "## Cross-Paper Scientific Consensus", "# Cross-Paper Scientific Consensus", "## Source Quality & Verification Audit", "# Source Quality & Verification Audit",
    "### Sources", "## Sources", "# Sources", "## General Web Sources", "## Academic Literature Sources",
)
