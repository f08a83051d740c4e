"""Vocabularies whose order is their priority, and patterns that decide what a text says."""

# Scale words and their factors, first match wins.
SCALES = (
    ("crore", 1e7), ("crores", 1e7), ("cr", 1e7), ("lakh", 1e5), ("lakhs", 1e5), ("lac", 1e5), ("lacs", 1e5), ("thousand", 1e3), ("thousands", 1e3), ("k", 1e3),
    ("million", 1e6), ("millions", 1e6), ("mn", 1e6), ("m", 1e6), ("billion", 1e9), ("billions", 1e9), ("bn", 1e9), ("b", 1e9), ("trillion", 1e12), ("trillions", 1e12), ("tn", 1e12),
)

# Unit spellings by canonical unit, first match wins.
UNITS = (
    ("INR", ("inr", "rs", "rs.", "₹", "rupees", "cr", "crore", "crores", "lakh", "lakhs")),
    ("USD", ("usd", "$", "dollar", "dollars")),
    ("percent", ("percent", "per cent", "%", "pct")),
    ("basis_points", ("bps", "basis points")),
    ("metric_tonnes", ("tonnes", "tons", "mn tons", "metric tonnes", "metric tons", "k tons")),
    ("shipments", ("shipments", "parcels", "express parcel shipments", "bn")),
    ("pin_codes", ("pin codes", "pin_codes", "pincodes")),
    ("centres", ("centres", "centers", "delivery centres")),
    ("vehicles", ("vehicles", "tractors", "46-ft tractors", "trucks")),
    ("persons", ("persons", "people", "employees", "workforce")),
    ("sq_ft", ("sq ft", "sq_ft", "sq. ft.", "mn sq ft", "million sq ft")),
    ("days", ("days",)),
)

# What a predicate says about its unit, first match wins.
UNIT_HINTS = (
    ("INR", ("revenue", "ebitda", "profit", "loss", "pat", "expenditure")),
    ("percent", ("growth", "inflation", "deficit", "rate", "margin", "share")),
    ("metric_tonnes", ("tonnage", "freight")),
    ("shipments", ("parcel", "shipment")),
    ("pin_codes", ("pin code",)),
    ("vehicles", ("tractor",)),
    ("centres", ("centre", "center")),
    ("sq_ft", ("area",)),
    ("persons", ("workforce",)),
)

# Known entities with type and aliases, first match wins.
ENTITIES = (
    ("Delhivery Limited", "organization", ("delhivery", "delhivery limited", "delhivery ltd.", "delhivery ltd", "the company", "company")),
    ("Spoton Logistics", "subsidiary", ("spoton", "spoton logistics", "spoton logistics private limited", "spoton logistics pvt ltd")),
    ("Reserve Bank of India", "central_bank", ("reserve bank of india", "rbi", "reserve bank", "central bank")),
    ("Republic of India", "country", ("republic of india", "india", "indian economy", "government of india", "mof", "ministry of finance")),
    ("International Monetary Fund", "multilateral_institution", ("international monetary fund", "imf", "fund")),
)

# Predicate families and their members, first match wins.
FAMILIES = (
    ("REVENUE", ("revenue from services", "revenue", "total revenue", "turnover", "sales", "topline", "revenue from operations")),
    ("EBITDA", ("ebitda", "service ebitda", "adjusted ebitda", "adj. ebitda", "operating profit", "operating ebitda")),
    ("FREIGHT_VOLUME", ("ptl freight tonnage", "freight tonnage", "freight volume", "part-truckload tonnage", "part truckload volume")),
    ("PARCEL_VOLUME", ("express parcel shipments volume", "parcel volume", "shipments volume", "express parcel volume", "shipments")),
    ("NETWORK_REACH", ("pin codes covered", "pincodes covered", "pin codes", "network reach", "coverage")),
    ("DELIVERY_CENTRES", ("last-mile delivery centres", "delivery centres", "centres", "delivery hubs")),
    ("FLEET_SIZE", ("count of 46-ft tractors", "tractors", "fleet size", "vehicles", "tractor fleet")),
    ("WORKFORCE", ("workforce strength", "workforce", "employee count", "headcount", "total workforce")),
    ("LOGISTICS_AREA", ("logistics area under management", "logistics area", "warehouse area", "infrastructure area")),
    ("GDP_GROWTH", ("real gdp growth rate", "gdp growth", "real gdp growth", "economic growth", "growth rate of gdp")),
    ("INFLATION", ("headline cpi inflation", "cpi inflation", "retail inflation", "headline inflation", "inflation rate")),
    ("FISCAL_DEFICIT", ("gross fiscal deficit", "fiscal deficit", "gfd", "central fiscal deficit")),
    ("CURRENT_ACCOUNT_DEFICIT", ("current account deficit", "cad", "current account balance")),
)

# Relationship types.
RELATIONSHIPS = ("CORROBORATES", "CONTRADICTS", "RECONCILES", "TEMPORALLY_EVOLVES", "SCOPE_DIFFERENCE", "UNIT_EQUIVALENT", "UNCERTAIN")
