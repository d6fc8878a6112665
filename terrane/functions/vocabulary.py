"""Fixed values of the heritage graph: codes, keywords and templates that results depend on."""

# Property codes of relations, and of metadata that is kept.
PROPERTY_RELATIONS = {"P84": "architect", "P131": "located_in", "P276": "located_in", "P186": "material_used", "P176": "built_by", "P361": "part_of", "P130": "related_to"}
METADATA_PROPERTIES = ["P17", "P31", "P1435", "P571", "P6375", "P625"]

CIDOC_RELATIONS = {
    "architect": "P14_carried_out_by",
    "built_by": "P108_was_produced_by",
    "founded_by": "P11_had_participant",
    "located_in": "P53_has_former_or_current_location",
    "part_of": "P46_is_composed_of",
    "material_used": "P45_consists_of",
    "time_span": "P4_has_time_span",
    "related_to": "P130_shows_features_of",
}
DEFAULT_CIDOC_RELATION = "P130_shows_features_of"
CIDOC_CLASSES = {
    "PER": "E21_Person",
    "GPE": "E53_Place",
    "LOC": "E53_Place",
    "FAC": "E27_Site",
    "HISTORICAL_RELICT": "E27_Site",
    "EVENT": "E5_Event",
    "DYNASTY": "E4_Period",
    "TIME": "E52_Time_Span",
    "ORG": "E74_Group",
    "ARTIFACT": "E22_Human-Made_Object",
    "MATERIAL": "E57_Material",
    "UNKNOWN": "E1_CRM_Entity",
}
DEFAULT_CIDOC_CLASS = "E1_CRM_Entity"

# Node types by words in an item's classes, in the order of their test.
NODE_KEYWORDS = [
    ("FAC", ["tower", "temple", "pagoda", "citadel", "monument", "heritage", "tháp", "chùa", "đền", "thành", "di tích", "miếu", "đình"]),
    ("MATERIAL", ["material", "alloy", "metal", "steel", "iron", "wood", "stone", "ceramic", "vật liệu", "hợp kim", "kim loại", "thép", "sắt", "gỗ", "đá", "gốm", "đất nung", "sứ", "gạch", "bê tông"]),
    ("ORG", ["organization", "company", "institution", "agency", "government agency", "public institution", "intermunicipal", "tổ chức", "công ty", "cơ quan", "viện"]),
    ("GPE", ["country", "city", "district", "province", "state", "kingdom", "department", "arrondissement", "administrative", "administrative unit", "geographical object", "territorial entity", "quốc gia", "thành phố", "quận", "huyện", "tỉnh", "vương quốc", "đơn vị hành chính", "địa danh"]),
    ("PER", ["human", "person", "people", "nhân vật", "con người", "người", "nhân vật lịch sử", "vua", "nữ hoàng", "hoàng đế", "hoàng hậu", "kiến trúc sư", "nghệ sĩ", "họa sĩ", "nhà điêu khắc", "lãnh đạo", "chính khách", "chủ tịch", "thủ tướng"]),
]

# Entity types by words, the first that is contained.
ONTOLOGY_KEYWORDS = [
    ("MATERIAL", ["material", "metal", "alloy", "steel", "wood", "stone", "brick", "ceramic", "bronze"]),
    ("FAC", ["tower", "temple", "pagoda", "museum", "monument", "castle", "fortress", "citadel", "bridge", "church", "cathedral", "mosque", "shrine", "building", "architecture"]),
    ("HISTORICAL_RELICT", ["heritage", "historical site", "archaeological site"]),
    ("GPE", ["district", "city", "province", "country", "village", "commune", "ward"]),
    ("LOC", ["mountain", "river", "lake", "forest", "island", "beach", "cave"]),
    ("PER", ["human", "person", "architect", "artist", "king", "emperor"]),
    ("ORG", ["organization", "company", "agency", "committee", "association", "university"]),
    ("EVENT", ["festival", "battle", "war", "ceremony"]),
    ("DYNASTY", ["dynasty", "historical period"]),
]

# Words of a location's name that make it a relict.
RELICT_WORDS = ["chùa", "đền", "lăng", "thành cổ", "cố đô", "vịnh", "hang", "động", "tháp", "vườn quốc gia", "phố cổ"]

# Canonical relations by words, in the order of their test.
CANONICAL_KEYWORDS = [
    ("architect", ["architect", "kiến trúc sư", "kiến trúc sư của", "thiết kế", "designed by", "thiết kế bởi"]),
    ("built_by", ["xây dựng", "built by", "constructed by", "được xây dựng bởi", "xây dựng bởi"]),
    ("located_in", ["located in", "located", "nằm ở", "ở", "tại"]),
    ("part_of", ["thuộc", "part of", "là một phần của", "là một phần trong"]),
    ("material_used", ["material", "làm bằng"]),
    ("time_span", ["thời gian", "time span", "year", "date", "năm nào", "khoảng thời gian", "năm bao nhiêu"]),
]

RELATION_ALIASES = {
    "architect": ["architect", "designed by", "kiến trúc sư", "thiết kế", "kiến trúc sư của"],
    "built_by": ["built by", "constructed by", "xây dựng", "do ai xây dựng", "được xây dựng bởi"],
    "founded_by": ["founded by", "sáng lập", "người sáng lập", "thành lập bởi", "được sáng lập bởi"],
    "located_in": ["located in", "nằm ở", "ở", "ở đâu", "vị trí tại"],
    "part_of": ["part of", "thuộc", "thuộc về", "là một phần của", "nằm trong"],
    "material_used": ["consists of", "làm bằng", "được làm bằng", "chất liệu", "chất liệu gì", "vật liệu", "vật liệu gì", "tạo bởi vật liệu gì", "được tạo bởi vật liệu gì", "thành phần", "material used"],
    "time_span": ["time span", "thời gian", "vào năm nào", "khi nào", "niên đại", "thời kỳ"],
    "related_to": ["related to", "liên quan đến", "đặc điểm của", "thể hiện"],
}

# What a question asks for, by words, in the order of their test.
QUESTION_KEYWORDS = [
    ("coordinates", ["kinh độ", "vĩ độ", "tọa độ", "coordinates", "latitude", "longitude"]),
    ("address", ["địa chỉ", "address", "ở số mấy", "đường nào", "vị trí cụ thể"]),
    ("description", ["mô tả", "description", "giới thiệu", "là gì", "thông tin về", "tóm tắt"]),
    ("country", ["quốc gia", "nước nào", "thuộc nước", "quốc tịch", "country"]),
    ("located_in", ["ở đâu", "nằm ở đâu", "vị trí", "địa điểm", "thuộc", "nằm ở"]),
    ("material_used", ["vật liệu", "chất liệu", "làm bằng", "được làm bằng", "thành phần"]),
    ("architect", ["kiến trúc sư", "architect", "thiết kế"]),
]
PROPERTY_RELATION_NAMES = ["coordinates", "address", "description", "country"]

# Properties that answer a relation, by words, in the order of their test.
PROPERTY_KEYWORDS = [
    ("coordinates", ["kinh độ", "vĩ độ", "tọa độ", "coordinates", "latitude", "longitude"]),
    ("address", ["địa chỉ", "address", "ở số mấy", "đường nào", "vị trí cụ thể", "địa chỉ cụ thể"]),
    ("description", ["mô tả", "description", "giới thiệu", "là gì", "thông tin về", "tóm tắt", "sơ lược"]),
    ("country", ["quốc gia", "nước nào", "thuộc nước", "quốc tịch", "country", "citizen of"]),
    ("location", ["located_in", "ở đâu", "nằm ở đâu", "vị trí", "thành phố", "city", "location"]),
]

# Pages: parts removed, headings ignored, citations.
REMOVED_TAGS = ["table", "style", "script"]
REMOVED_CLASSES = ["infobox", "navbox", "vertical-navbox", "reference", "reflist", "thumb", "toc", "metadata", "mw-editsection", "mbox-small"]
IGNORED_SECTIONS = ["Xem thêm", "Tham khảo", "Liên kết ngoài", "Ghi chú", "Chú thích", "Tài liệu tham khảo"]
DEFAULT_SECTION = "Giới thiệu"
DEFAULT_CHUNK_SECTION = "Tổng quan"
CITATION = r"\[\d+\]|\[[a-zA-Z]+\]|\[cần dẫn nguồn\]"

# Thresholds.
DEDUP_RATIO, LINKAGE_RATIO, LINKING_RATIO = 90, 92, 80
RELATION_FLOOR, RELATION_KEPT, RELATION_FALLBACK = 0.35, 15, 10
PATH_FLOOR, STOP_SCORE, STOP_DROP, LEAST_BEAM = 0.25, 0.92, 0.85, 3
CHUNK, OVERLAP, LEAST_PARAGRAPH, LEAST_SECTION = 800, 100, 30, 50
RELATION_WEIGHT, STRUCTURE_WEIGHT, TARGET_WEIGHT, LENGTH_PENALTY, MATERIAL_SIMILARITY = 0.55, 0.25, 0.20, 0.15, 0.1

# Sentences.
NO_ENTITY = "No entity found."
