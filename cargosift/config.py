"""Settings and fixed values of shipment screening."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field, fields, replace

# Enumerations, thresholds and word lists that results depend on.
DIMENSIONS = ("goods", "party", "geography", "valuation", "hs_code", "data_quality", "model_uncertainty", "dual_use", "cross_border")
SEVERITIES = ("none", "low", "medium", "high", "critical")
LABELS = ("allowed", "restricted", "needs_review")
ACTIONS = ("block", "approve", "manual_review")
COUNTRY_LEVELS = {"unknown": 0.0, "low": 0.25, "medium": 0.5, "high": 0.8, "critical": 1.0}
DUAL_USE_CHAPTERS = ("84", "85", "87", "88", "89", "90")
DUAL_USE_KEYWORDS = (
    "high-performance computing", "high performance computing", "gpu cluster", "encryption", "cryptographic", "centrifuge", "precursor",
    "surveillance", "drone", "uav", "lidar", "night vision", "thermal imaging", "nuclear", "biotech", "gene synthesis",
    "aerospace grade", "military grade", "export controlled",
)
DUAL_USE_CONCEPTS = (
    "encryption or cryptographic equipment for secure communications",
    "high-performance computing cluster or GPU accelerator",
    "gas centrifuge or uranium enrichment equipment",
    "chemical precursor for weapons or narcotics synthesis",
    "surveillance, wiretapping, or interception equipment",
    "unmanned aerial vehicle, drone, or UAV component",
    "LIDAR, night vision, or thermal imaging system",
    "nuclear reactor component or fissile material handling",
    "biotechnology or gene synthesis equipment",
    "aerospace-grade or military-grade alloys or composites",
    "guidance, navigation, or inertial measurement unit",
    "radiation-hardened electronics or rad-hard components",
    "satellite communication terminal or VSAT equipment",
    "machine tool capable of multi-axis precision manufacturing",
    "high-voltage pulse power or directed energy systems",
)
HYPOTHESES = (
    "This shipment is allowed for export without restrictions.",
    "This shipment contains restricted or controlled items.",
    "This shipment requires further review by a compliance officer.",
)
# Tariff chapters of the Harmonized System and their short titles; 77 is reserved.
HS_CHAPTERS = dict(
    line.split(" ", 1)
    for line in """\
01 Live animals
02 Meat and edible meat offal
03 Fish and seafood
04 Dairy, eggs, honey
05 Other animal products
06 Live plants, cut flowers
07 Vegetables
08 Fruits and nuts
09 Coffee, tea, spices
10 Cereals
11 Milling products, malt, starch
12 Oil seeds, industrial plants
13 Lac, gums, resins
14 Vegetable plaiting materials
15 Animal and vegetable fats and oils
16 Meat and fish preparations
17 Sugars and confectionery
18 Cocoa and cocoa preparations
19 Cereal, flour, milk preparations
20 Preparations of vegetables, fruit, nuts
21 Miscellaneous edible preparations
22 Beverages, spirits, vinegar
23 Residues, animal feed
24 Tobacco
25 Salt, sulphur, earths, stone, plaster, cement
26 Ores, slag, ash
27 Mineral fuels, oils, waxes
28 Inorganic chemicals
29 Organic chemicals
30 Pharmaceutical products
31 Fertilizers
32 Tanning, dyeing extracts, paints, inks
33 Essential oils, perfumery, cosmetics
34 Soap, washing preparations, candles
35 Albuminoidal substances, glues, enzymes
36 Explosives, pyrotechnics, matches
37 Photographic goods
38 Miscellaneous chemical products
39 Plastics and articles thereof
40 Rubber and articles thereof
41 Raw hides, skins, leather
42 Articles of leather
43 Furskins and artificial fur
44 Wood and articles of wood
45 Cork and articles of cork
46 Manufactures of straw, basketware
47 Pulp of wood
48 Paper and paperboard
49 Printed books, newspapers
50 Silk
51 Wool, fine animal hair, horsehair
52 Cotton
53 Other vegetable textile fibres
54 Man-made filaments
55 Man-made staple fibres
56 Wadding, felt, nonwovens, twine, ropes
57 Carpets and other textile floor coverings
58 Special woven fabrics, tapestries, lace
59 Impregnated, coated textile fabrics
60 Knitted or crocheted fabrics
61 Apparel, knitted or crocheted
62 Apparel, not knitted or crocheted
63 Other made-up textile articles
64 Footwear, gaiters
65 Headgear
66 Umbrellas, walking-sticks, riding-crops
67 Prepared feathers, artificial flowers
68 Articles of stone, plaster, cement
69 Ceramic products
70 Glass and glassware
71 Precious metals, jewellery
72 Iron and steel
73 Articles of iron or steel
74 Copper and articles thereof
75 Nickel and articles thereof
76 Aluminium and articles thereof
78 Lead and articles thereof
79 Zinc and articles thereof
80 Tin and articles thereof
81 Other base metals and articles
82 Tools, cutlery, hand tools
83 Miscellaneous articles of base metal
84 Machinery, nuclear reactors, boilers
85 Electrical machinery and equipment
86 Railway or tramway equipment
87 Vehicles other than railway
88 Aircraft, spacecraft
89 Ships, boats, floating structures
90 Optical, photographic, medical instruments
91 Clocks and watches
92 Musical instruments
93 Arms and ammunition
94 Furniture, lighting, prefab buildings
95 Toys, games, sports equipment
96 Miscellaneous manufactured articles
97 Works of art, collector's pieces, antiques
98 Special classification provisions
99 Temporary legislation""".splitlines()
)
# What each chapter covers, the text that is embedded for it.
HS_DESCRIPTIONS = dict(
    line.split(" ", 1)
    for line in """\
01 Live animals including cattle, sheep, horses, pigs, poultry, and other livestock
02 Fresh, chilled or frozen meat and edible offal of cattle, pigs, poultry, sheep
03 Fish, crustaceans, molluscs, aquatic invertebrates — fresh, frozen, or processed seafood
04 Milk, cream, butter, cheese, yoghurt, eggs, natural honey, edible animal products
05 Human hair, bones, shells, coral, ivory, feathers — products of animal origin not elsewhere classified
06 Live trees, plants, bulbs, roots, cut flowers, ornamental foliage
07 Edible vegetables, roots, tubers — fresh, chilled, or frozen
08 Edible fruits and nuts, peel of citrus fruits or melons
09 Coffee, tea, maté, mate, spices including pepper, cinnamon, cloves, nutmeg
10 Wheat, rice, barley, oats, maize, sorghum and other cereal grains
11 Flour, groats, meal, malt, starches, wheat gluten, inulin
12 Oil seeds, oleaginous fruits, industrial or medicinal plants, straw, fodder
13 Lac, natural gums, resins, balsams, vegetable saps and extracts
14 Bamboo, rattan, vegetable materials used for plaiting, stuffing, or padding
15 Edible and inedible animal or vegetable fats, oils, waxes — soybean oil, palm oil, tallow
16 Preparations of meat, fish, crustaceans — sausages, canned meat, prepared seafood
17 Cane sugar, beet sugar, molasses, sugar confectionery, chocolate-free candies
18 Cocoa beans, cocoa paste, cocoa butter, chocolate, chocolate confectionery
19 Pasta, bread, pastry, cakes, biscuits, breakfast cereals, prepared foods of flour
20 Jams, jellies, marmalades, fruit juices, canned or preserved vegetables and fruit
21 Coffee extracts, sauces, soups, broths, ice cream, yeast, food preparations
22 Water, mineral water, beer, wine, spirits, vinegar, alcoholic and non-alcoholic drinks
23 Residues and waste from food industries, prepared animal feed, oil-cake, bran
24 Unmanufactured tobacco, cigars, cigarettes, tobacco products, vaping products
25 Salt, sulphur, earths and stone, plastering materials, lime, cement
26 Metal ores, slag, ash — iron ore, copper ore, aluminium ore, uranium ore, radioactive ores
27 Petroleum, crude oil, natural gas, coal, coke, petroleum waxes, mineral fuels
28 Inorganic chemicals, rare earth compounds, isotopes, radioactive elements, uranium, plutonium
29 Organic chemicals, hydrocarbons, alcohols, ethers, amines, antibiotics precursors
30 Medicaments, vaccines, blood products, bandages, dental cements, pharmaceutical products
31 Mineral or chemical fertilizers — nitrogenous, phosphatic, potassic
32 Tanning extracts, dyes, pigments, paints, varnishes, printing inks
33 Essential oils, perfumes, cosmetics, toiletries, soaps, shampoos
34 Soap, detergents, washing preparations, lubricants, waxes, polishes, candles
35 Casein, albumins, gelatin, peptones, dextrins, starches, glues, enzymes
36 Explosives, propellant powders, fuses, detonators, fireworks, matches, pyrotechnic articles
37 Photographic or cinematographic film, plates, paper, chemical preparations
38 Insecticides, herbicides, disinfectants, lubricants, catalysts, miscellaneous chemicals
39 Polymers, plastics in primary forms, plastic sheets, tubes, articles of plastic
40 Natural rubber, synthetic rubber, vulcanised rubber, tyres, rubber articles
41 Raw hides, skins, tanned or dressed leather, fur skins
42 Handbags, suitcases, saddlery, harness, travel goods, articles of leather
43 Raw furskins, tanned furskins, articles of fur, artificial fur
44 Fuel wood, lumber, plywood, wood chips, wood articles, charcoal
45 Natural cork, agglomerated cork, articles of cork
46 Plaited materials, basketware, wickerwork
47 Wood pulp, paper pulp, recovered paper or paperboard
48 Paper, paperboard, articles of paper — newsprint, kraft paper, cardboard boxes
49 Printed books, newspapers, pictures, maps, music scores, printed matter
50 Silk, silk yarn, silk fabrics, silkworm cocoons
51 Wool, fine or coarse animal hair, horsehair yarn and woven fabric
52 Raw cotton, cotton yarn, cotton fabrics
53 Flax, jute, hemp, ramie, paper yarn and woven fabrics
54 Synthetic and artificial filament yarn, woven fabrics of man-made filaments
55 Synthetic staple fibres, woven fabrics of man-made staple fibres
56 Wadding, felt, nonwovens, special yarns, twine, cordage, ropes, cables
57 Carpets, rugs, woven floor coverings, knotted or tufted carpets
58 Terry towelling, gauze, tapestries, lace, embroidery, trimmings
59 Impregnated, coated, covered or laminated textile fabrics, conveyor belts, hose
60 Knitted or crocheted fabrics of textile materials
61 Knitted or crocheted articles of apparel and clothing accessories — T-shirts, sweaters, underwear
62 Woven articles of apparel — suits, shirts, trousers, dresses, coats
63 Bed linen, blankets, curtains, tents, worn clothing, rags, textile articles
64 Shoes, boots, sandals, sports footwear, parts of footwear, gaiters
65 Hats, caps, headgear and parts thereof
66 Umbrellas, sun umbrellas, walking sticks, riding-crops, whips
67 Prepared feathers, articles of feathers, artificial flowers, articles of human hair
68 Articles of stone, plaster, cement, asbestos, mica, building materials
69 Bricks, tiles, sanitary ware, porcelain, ceramic tableware, refractory goods
70 Glass in primary forms, glass fibres, glass containers, glassware, optical glass
71 Pearls, precious stones, diamonds, gold, silver, platinum, jewellery, coins
72 Pig iron, ingots, flat-rolled products, bars, rods, wires of iron or steel
73 Tubes, pipes, nails, screws, springs, structures, containers of iron or steel
74 Copper, unwrought and wrought, refined copper, copper articles
75 Nickel, unwrought and wrought, nickel alloys, nickel articles
76 Aluminium, unwrought and wrought, aluminium alloys, foil, articles of aluminium
78 Lead, unwrought and wrought, lead articles
79 Zinc, unwrought and wrought, zinc articles
80 Tin, unwrought and wrought, tin articles
81 Tungsten, molybdenum, tantalum, titanium, zirconium, cobalt, and other base metals
82 Tools, cutlery, spoons, forks, knives, hand tools, saw blades
83 Locks, keys, hinges, safes, fittings, mountings, bells, statuettes of base metal
84 Nuclear reactors, boilers, machinery, mechanical appliances, turbines, engines, pumps, computers
85 Electrical machinery, electrical equipment, motors, generators, batteries, telephones, integrated circuits, semiconductors, encryption equipment
86 Railway locomotives, rolling stock, tramway vehicles, track fixtures, signalling equipment
87 Motor vehicles, tractors, motorcycles, bicycles, trailers, vehicle parts
88 Aircraft, spacecraft, helicopters, balloons, aircraft parts, satellites, launch vehicles
89 Cruise ships, cargo ships, warships, yachts, fishing vessels, floating structures
90 Optical instruments, cameras, microscopes, medical and surgical instruments, measuring and checking instruments, lasers, thermal imaging
91 Clocks, watches, clock movements, watch parts, time of day recording apparatus
92 Pianos, string instruments, wind instruments, electronic musical instruments
93 Firearms, weapons, ammunition, military weapons, parts and accessories of weapons
94 Furniture, mattresses, lamps, lighting fittings, illuminated signs, prefabricated buildings
95 Toys, games, sports equipment, fishing rods, playing cards, festival articles
96 Brooms, brushes, pens, pencils, buttons, zippers, vacuum flasks, miscellaneous articles
97 Paintings, drawings, sculpture, collections, antiques over 100 years old
98 Special classification provisions (country-specific)
99 Temporary modifications of import duties (country-specific)""".splitlines()
)
# The sample country-risk, taxonomy, denied-party and tier settings.
COUNTRIES = [
    dict(zip(("country_code", "country_name", "overall_risk", "overall_score", "sanctions_status", "fatf_status", "transshipment_hub", "sanctioned_neighbors"), row, strict=True))
    for row in (
        ("US", "United States", "low", 0.15, "none", "compliant", False, []),
        ("CA", "Canada", "low", 0.10, "none", "compliant", False, []),
        ("GB", "United Kingdom", "low", 0.12, "none", "compliant", False, []),
        ("DE", "Germany", "low", 0.15, "none", "compliant", False, []),
        ("SG", "Singapore", "low", 0.22, "none", "compliant", True, []),
        ("HK", "Hong Kong", "medium", 0.45, "none", "compliant", True, []),
        ("AE", "United Arab Emirates", "medium", 0.55, "none", "grey", True, ["IR"]),
        ("PA", "Panama", "medium", 0.50, "none", "grey", True, []),
        ("TR", "Türkiye", "medium", 0.55, "none", "grey", False, ["IR", "SY"]),
        ("RU", "Russia", "critical", 0.95, "comprehensive", "unknown", False, []),
        ("IR", "Iran", "critical", 1.00, "comprehensive", "black", False, []),
        ("KP", "North Korea", "critical", 1.00, "comprehensive", "black", False, []),
        ("SY", "Syria", "critical", 1.00, "comprehensive", "unknown", False, []),
        ("CU", "Cuba", "critical", 0.90, "comprehensive", "unknown", False, []),
        ("MM", "Myanmar", "high", 0.80, "sectoral", "black", False, []),
        ("VE", "Venezuela", "high", 0.80, "sectoral", "unknown", False, []),
        ("PK", "Pakistan", "medium", 0.55, "none", "grey", False, []),
        ("CN", "China", "medium", 0.55, "sectoral", "unknown", False, []),
        ("BY", "Belarus", "critical", 0.90, "comprehensive", "unknown", False, []),
    )
]
TAXONOMY = [
    {"group_id": "hazardous_materials", "name": "Hazardous Materials", "risk_level": "critical", "allow_auto_clear": False, "hard_keywords": [],
     "semantic_phrases": ["explosive materials", "flammable liquids", "radioactive material", "corrosive substances", "oxidizing agents", "dangerous goods imdg", "compressed gas"]},
    {"group_id": "military_and_dual_use", "name": "Military and Dual-Use Equipment", "risk_level": "critical", "allow_auto_clear": False, "hard_keywords": ["ak47"],
     "semantic_phrases": ["military equipment", "missile systems", "guided missile", "radar system", "military firearms", "export controlled weapons", "military grade weapon systems", "defense export controlled equipment"]},
    {"group_id": "restricted_biology_and_wildlife", "name": "Restricted Biology and Wildlife", "risk_level": "high", "allow_auto_clear": False, "hard_keywords": ["ivory"],
     "semantic_phrases": ["live livestock", "protected wildlife", "live animal"]},
]
PARTIES = [
    {"name": "Blocked Industries Ltd", "aliases": ["Blocked Industries", "Blocked Industries Limited"], "country": "XX", "list_name": "sample_denied_parties"},
    {"name": "Sanctioned Holding Corp", "aliases": ["Sanctioned Holding", "Sanctioned Holdings"], "country": "YY", "list_name": "sample_denied_parties"},
    {"name": "Prohibited Trading Company", "aliases": [], "country": "ZZ", "list_name": "sample_denied_parties"},
]
TIERS = {"AA": 1, "BB": 2, "CC": 3, "DD": 4, "XX": 4, "YY": 4, "ZZ": 4}
LEGACY_WEIGHTS = {"origin_country": 0.25, "destination_country": 0.25, "high_value": 0.15, "round_value": 0.10, "sensitive_hs": 0.15, "missing_fields": 0.10}
PROFILE_WEIGHTS = {"goods": 2.5, "party": 2.5, "geography": 1.2, "valuation": 1.0, "hs_code": 1.0, "data_quality": 0.8, "model_uncertainty": 1.0, "dual_use": 1.3, "cross_border": 2.0}


@dataclass(frozen=True)
class Screening:
    """All knobs of the engine; from_json and from_env override by field name."""

    tiers: dict = field(default_factory=lambda: dict(TIERS))
    legacy_weights: dict = field(default_factory=lambda: dict(LEGACY_WEIGHTS))
    dimension_weights: dict = field(default_factory=lambda: dict(PROFILE_WEIGHTS))
    sensitive_prefixes: tuple = ("93", "36", "28")
    high_value: float = 100_000.0
    very_high_value: float = 1_000_000.0
    round_tolerance: float = 0.01
    round_base: float = 10_000.0
    similarity: dict = field(default_factory=lambda: {"critical": 0.75, "high": 0.78, "medium": 0.80})
    approve_confidence: float = 0.90
    block_confidence: float = 0.90
    entity_block: float = 0.92
    fuzzy_match: float = 0.80
    dual_use_similarity: float = 0.55
    hs_top_k: int = 3
    many_transit: int = 2
    model_version: str = "cargosift-1"
    classifier: str = "logits"

    @classmethod
    def from_json(cls, path: str | None) -> Screening:
        """Settings of a JSON file; a missing file gives the defaults, unknown keys are left out, empty weights mean the defaults."""
        if not path or not os.path.exists(path):
            return cls()
        with open(path) as f:
            got = json.load(f)
        got = {"tiers": got.get("country_tiers"), "high_value": got.get("high_value_threshold"), "round_tolerance": got.get("round_value_tolerance"), "sensitive_prefixes": got.get("sensitive_hs_prefixes"), "legacy_weights": got.get("weights")} | got
        weights = {k: float(v) for k, v in (got.get("dimension_weights") or {}).items() if k in DIMENSIONS}
        got["dimension_weights"] = weights or None
        names = {f.name for f in fields(cls)}
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in got.items() if k in names and v is not None})

    def from_env(self, prefix: str = "CARGOSIFT_") -> Screening:
        """Number and text fields overridden by environment variables such as CARGOSIFT_HIGH_VALUE."""
        found = {}
        for f in fields(self):
            old, new = getattr(self, f.name), os.environ.get(prefix + f.name.upper())
            if new is not None and isinstance(old, (int, float, str)):
                found[f.name] = type(old)(new)
        return replace(self, **found)
