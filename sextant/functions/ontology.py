"""The relation ontology."""

# Group names and example phrases that prototypes are built from.
GROUPS: dict[str, list[str]] = {
    "LOCATED_IN": ["located in", "location of", "situated in", "administrative division of", "administrative region of", "country of", "city of", "region of", "province of", "municipality of", "district of", "state of", "belongs to country", "in country", "in city", "in region"],
    "NEAR": ["near", "adjacent to", "next to", "close to", "neighbor of", "nearby", "around", "in vicinity of", "within walking distance", "around the corner"],
    "PART_OF": ["part of", "component of", "within", "contained in", "belongs to", "included in", "subdivision of", "section of", "member of", "element of"],
    "HAS_COORDINATES": ["has coordinates", "latitude", "longitude", "geographic coordinates", "geo location", "gps location"],
    "ALIAS_OF": ["alias", "alias of", "also known as", "alternate name", "alternative name", "former name", "short name", "nickname", "local name", "native name"],
    "IDENTIFIED_AS": ["identified as", "classified as", "defined as", "considered as", "recognized as"],
    "ABOUT": ["about", "describes", "description of", "refers to", "mentions", "discusses", "related topic", "concerns", "focuses on"],
    "RELATED_TO": ["related to", "associated with", "affiliated with", "aligned with", "connected to", "linked to", "correlated with", "interaction with"],
    "CREATED_BY": ["created by", "designed by", "built by", "constructed by", "developed by", "engineered by", "produced by", "authored by"],
    "FOUNDED_IN": ["founded in", "established in", "originated in", "formed in", "created in", "opened in"],
    "DEDICATED_TO": ["dedicated to", "named after", "commemorates", "in honor of"],
    "USED_FOR": ["used for", "purpose", "intended for", "serves as", "function of", "application of"],
    "ACCESSIBLE_VIA": ["accessed via", "accessed by", "reachable via", "access through", "connected via", "transport via"],
    "OPERATED_BY": ["operated by", "managed by", "run by", "administered by", "maintained by"],
    "OCCURRED_IN": ["occurred in", "happened in", "took place in", "held in", "event in"],
    "DATE_OF": ["date of", "year of", "time of", "period of", "during"],
    "CULTURAL_ASSOCIATION": ["cultural association", "heritage of", "tradition of", "symbol of", "icon of"],
    "LANGUAGE_ASSOCIATION": ["language of", "spoken in", "written in", "associated language"],
    "ADMINISTERED_BY": ["administered by", "governed by", "regulated by", "jurisdiction of"],
    "DESIGNATED_AS": ["designated as", "classified as", "listed as", "recognized as", "declared as"],
    "SOURCE_OF": ["source of", "derived from", "origin of"],
    "MENTIONED_IN": ["mentioned in", "appears in", "referenced in", "cited in"],
    "OTHER": ["other", "miscellaneous", "unspecified"],
}
