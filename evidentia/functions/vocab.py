"""Closed vocabularies and weights of the model."""

# Results depend on each of them.
PAGE_TYPES = [
    "entity", "concept", "summary", "comparison", "overview", "analysis", "meeting_note", "client_source",
    "candidate_request", "request", "requirement", "implementation", "test_result", "decision", "release",
    "risk", "data_model", "automation", "integration", "api",
]
EDGE_WEIGHTS = {
    "implements": 1.0, "tests": 1.0, "released_by": 0.9, "same_request": 0.9, "links_to": 0.7,
    "derived_from": 0.55, "belongs_to_client": 0.4, "belongs_to_project": 0.4, "has_tag": 0.25,
}
HUB_KINDS = ["source", "tag", "client", "project"]
COMPONENT_TYPES = ["implementation", "api", "integration", "automation", "data_model"]
CLAIM_KINDS = [
    "fact", "requirement", "decision", "constraint", "invariant", "exception", "behavior", "risk", "incident",
    "procedure", "inference", "hypothesis",
]
CLAIM_STATUS_PRIORITY = {"active": 0, "ambiguous": 1, "superseded": 2, "contradicted": 3}
STOP_WORDS = [
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "how", "in", "is",
    "of", "on", "or", "that", "the", "this", "to", "what", "when", "where", "which", "with",
    "al", "alla", "alle", "con", "da", "dal", "dalla", "de", "dei", "del", "della", "di", "e",
    "gli", "i", "il", "la", "le", "lo", "nel", "nella", "o", "per", "su", "tra", "un", "una",
    "analyze", "debug", "describe", "explain", "find", "implement", "modify", "retrieve", "review", "show",
    "understand", "update", "verify", "please", "context", "project", "system",
    "analizza", "analizzare", "capire", "comprendere", "contesto", "descrivi", "descrivere", "evidenzia",
    "evidenziare", "evidenziando", "implementa", "implementare", "includere", "includendo", "modifica",
    "modificare", "mostra", "mostrare", "progetto", "recupera", "recuperare", "revisiona", "revisionare",
    "sistema", "spiega", "spiegare", "trova", "trovare", "verifica", "verificare",
]
ENGLISH_SUFFIXES = ["izations", "isation", "ization", "ments", "ment", "ingly", "edly", "ing", "ies", "ed", "es", "s"]
ITALIAN_SUFFIXES = ["azioni", "azione", "amenti", "amento", "mente", "ando", "endo", "ato", "ata", "ati", "ate", "are", "ere", "ire"]
#: Page type that a query asks for, by the words in it.
REQUIRED_TYPE_WORDS = {
    "requirement": ["requirement", "requirements", "requisito", "requisiti"],
    "decision": ["decision", "decisions", "decisione", "decisioni"],
    "implementation": ["implementation", "implementations", "implementazione", "implementazioni"],
    "test_result": ["test", "tests", "verification", "verifica", "verifiche"],
    "analysis": ["incident", "incidents", "incidente", "incidenti"],
}
DEFAULT_HEADING = "Introduzione"
#: BM25 k1 and b by profile, field weights, boost of an exact id or title.
PROFILES = {"precision": (1.0, 0.75), "balanced": (1.4, 0.75), "coverage": (1.4, 0.55)}
TITLE_WEIGHT, META_WEIGHT, EXACT_BOOST = 5.0, 2.5, 8.0
FUSION_K, SEMANTIC_WEIGHT, GRAPH_WEIGHT = 60, 0.7, 0.65
HOP_DECAY = 0.6
