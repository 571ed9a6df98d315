"""Fixed values that results depend on: labels, relation types and the links of a paper to what it mentions."""

ENTITY_TYPES = ("Person", "Organization", "Paper", "Concept", "Event", "Topic")
RELATION_TYPES = (
    "AUTHORED", "CITED", "COLLABORATED_WITH", "AFFILIATED_WITH", "FUNDED_BY", "USES", "PROPOSES", "EXTENDS", "EVALUATED_ON", "APPLIED_TO",
    "PART_OF", "RELATED_TO", "IMPROVES", "COMPARED_TO", "PUBLISHED_IN", "SUPPORTS", "CONTRADICTS", "CONFLICTS_WITH",
)
#: The relation of a paper to an extracted entity of a type; MENTIONS for any other type but those that are left unlinked.
PAPER_LINKS = {"Concept": "MENTIONS", "Topic": "ABOUT", "Organization": "AFFILIATED_WITH", "Event": "PRESENTED_AT"}
UNLINKED = ("Person", "Paper")
#: Relations that a hypothesis may predict, and what stands for any other.
PREDICTED, PREDICTED_ELSE = ("AUTHORED", "CITED", "FUNDED_BY", "CONFLICTS_WITH", "COLLABORATED_WITH", "PUBLISHED_IN", "SUPPORTS", "CONTRADICTS"), "SUPPORTS"
ROUTES, ROUTE_ELSE = ("graph", "vector", "hybrid"), "hybrid"
CONFIDENCES, CONFIDENCE_ELSE = ("low", "medium", "high"), "medium"
