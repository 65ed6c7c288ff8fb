"""Every list, table, phrase and number that results depend on.

Nothing in this module is logic. The values are stated as they must appear in results;
operators read them through ``params`` and ``dims`` and all of them can be overridden there.
"""

# ---- fixed values: identity namespace, city frame -------------------------------------
EVENT_NAMESPACE = "1f0a7b2c-3d4e-4f50-9a61-7b8c9d0e1f20"
CITY_TZ = "Asia/Kolkata"
CITY_BBOX = (26.79, 75.69, 26.99, 75.89)  # south-west lat, lon, north-east lat, lon
CITY_CENTRE = (26.9124, 75.7873)
HEX_EDGE_M = 531.0

# ---- fixed values: feeds: id, interval seconds, format, file, label en, label hi -------
FEEDS = (
    ("weather_imd", 300, "jsonl", "raw_weather_imd.jsonl", "Weather station", "मौसम स्टेशन"),
    ("civic_complaints", 60, "csv", "raw_civic_complaints.csv", "Civic complaints", "नागरिक शिकायतें"),
    ("power_discom", 120, "jsonl", "raw_power_discom.jsonl", "Power grid", "बिजली ग्रिड"),
    ("drain_scada", 600, "jsonl", "raw_drain_scada.jsonl", "Storm-drain sensors", "नाला स्तर सेंसर"),
    ("air_sensors", 180, "jsonl", "raw_air_sensors.jsonl", "Air quality sensors", "वायु गुणवत्ता सेंसर"),
)

# ---- fixed values: category -> feeds that emit it, and its severity ramp (floor, ceiling)
CATEGORIES = (
    ("weather.rain", ("weather_imd",), 5.0, 40.0),
    ("weather.heat", ("weather_imd",), 38.0, 50.0),
    ("air.pm25", ("air_sensors",), 60.0, 300.0),
    ("power.outage", ("power_discom",), 200.0, 8000.0),
    ("traffic.signal_down", ("power_discom", "civic_complaints"), 1.0, 6.0),
    ("drain.overflow", ("drain_scada",), 85.0, 130.0),
    ("complaint.waterlogging", ("civic_complaints",), 1.0, 12.0),
    ("complaint.garbage", ("civic_complaints",), 1.0, 12.0),
    ("complaint.streetlight", ("civic_complaints",), 1.0, 12.0),
    ("complaint.road_damage", ("civic_complaints",), 1.0, 12.0),
    ("complaint.smoke", ("civic_complaints",), 1.0, 12.0),
)
SUSTAINED_CATEGORIES = ("weather.heat", "air.pm25")

# ---- fixed values: complaint wording -> category ---------------------------------------
COMPLAINT_TYPES = (
    ("water logging", "complaint.waterlogging"),
    ("waterlogging", "complaint.waterlogging"),
    ("water-logging", "complaint.waterlogging"),
    ("jal bharav", "complaint.waterlogging"),
    ("garbage", "complaint.garbage"),
    ("garbage not lifted", "complaint.garbage"),
    ("solid waste", "complaint.garbage"),
    ("kachra", "complaint.garbage"),
    ("street light not working", "complaint.streetlight"),
    ("street light", "complaint.streetlight"),
    ("streetlight", "complaint.streetlight"),
    ("street lamp", "complaint.streetlight"),
    ("road damage", "complaint.road_damage"),
    ("pothole", "complaint.road_damage"),
    ("potholes", "complaint.road_damage"),
    ("broken road", "complaint.road_damage"),
    ("smoke", "complaint.smoke"),
    ("burning", "complaint.smoke"),
    ("smoke/burning", "complaint.smoke"),
    ("garbage burning", "complaint.smoke"),
    ("signal not working", "traffic.signal_down"),
    ("traffic signal not working", "traffic.signal_down"),
    ("signal down", "traffic.signal_down"),
    ("traffic signal", "traffic.signal_down"),
)

# ---- fixed values: gazetteer: name, Hindi name, lat, lon --------------------------------
LANDMARKS = (
    ("Hawa Mahal", "हवा महल", 26.9239, 75.8267),
    ("Amer Fort", "आमेर किला", 26.9855, 75.8513),
    ("Jal Mahal", "जल महल", 26.9535, 75.8460),
    ("Albert Hall Museum", "अल्बर्ट हॉल", 26.9117, 75.8197),
    ("Jaipur Junction", "जयपुर जंक्शन", 26.9196, 75.7878),
    ("Sindhi Camp", "सिंधी कैंप", 26.9268, 75.7930),
    ("Vaishali Nagar", "वैशाली नगर", 26.9124, 75.7370),
    ("Malviya Nagar", "मालवीय नगर", 26.8549, 75.8106),
    ("Mansarovar", "मानसरोवर", 26.8505, 75.7628),
    ("Vidyadhar Nagar", "विद्याधर नगर", 26.9580, 75.7810),
    ("Tonk Road", "टोंक रोड", 26.8830, 75.8040),
    ("Jagatpura", "जगतपुरा", 26.8260, 75.8420),
    ("Sanganer", "सांगानेर", 26.8200, 75.7900),
)
ADDRESS_PREFIXES = ("near", "opp", "opposite", "behind", "nr.", "nr", "in front of", "next to")
MIN_ADDRESS_LETTERS = 4

# ---- fixed values: masking of names and phones ------------------------------------------
NAME_TAG = "[name]"
PHONE_TAG = "[phone]"
PHONE_PATTERN = r"(?<![\w])\+?\d[\d\s-]{7,18}\d(?![\w])"
PHONE_PREFIXES = ("0091", "91", "0")
NAME_PATTERN = r"\b[A-Z][a-z]{2,}(?:\s+[A-Z][a-z]{2,})?\b"
NOT_NAMES = (
    "Ward", "Near", "Opp", "Opposite", "Behind", "Next", "Front", "The", "This",
    "Please", "Sir", "Madam", "Road", "Street", "Gate", "Block", "Sector", "Phase",
    "Open", "Closed", "Water", "Garbage", "Smoke", "Signal", "Light", "Pothole",
)
FREE_TEXT_FIELDS = {"civic_complaints": ("text",)}

# ---- fixed values: confidence by source class and multipliers ----------------------------
CONF_CALIBRATED = 0.90
CONF_UNCALIBRATED = 0.60
CONF_RESIDENT = 0.70
MULT_DIRECT = 1.0
MULT_REGISTRY = 0.80
MULT_LANDMARK = 0.85
MULT_LOW_BATTERY = 0.50
CONF_FLOOR = 0.30
SCHEDULED_CUT_CAP = 0.4
LOW_BATTERY_PCT = 15
LOW_BATTERY_VOLTS = 11.2
LEVEL_FAULT = -999.0
PM_FAULT = -1.0

# ---- fixed values: alert levels ---------------------------------------------------------
ALERT_CUTOFFS = ((0, "green"), (25, "yellow"), (50, "orange"), (75, "red"))
CONFIDENCE_LEVELS = ("low", "med", "high")
ALERT_WORDS = (
    ("green", "All normal", "सब सामान्य है"),
    ("yellow", "Be aware", "सतर्क रहें"),
    ("orange", "Be prepared", "तैयार रहें"),
    ("red", "Take action", "कार्रवाई करें"),
)

# ---- fixed values: heat index regression (NWS Rothfusz coefficients) ---------------------
ROTHFUSZ = (-42.379, 2.04901523, 10.14333127, -0.22475541, -0.00683783, -0.05481717,
            0.00122874, 0.00085282, -0.00000199)

# ---- fixed values: plausible cause -> effect pairs: window minutes, reason en, reason hi --
PLAUSIBLE_PAIRS = (
    ("weather.rain", "complaint.waterlogging", 0, 90,
     "heavy rain pools in low-lying streets within the hour",
     "तेज़ बारिश का पानी एक घंटे के भीतर नीची सड़कों पर भर जाता है"),
    ("weather.rain", "power.outage", 0, 120,
     "water reaching a feeder or transformer trips the circuit",
     "फीडर या ट्रांसफॉर्मर में पानी जाने से सर्किट ट्रिप होता है"),
    ("weather.rain", "drain.overflow", 0, 60,
     "a burst of rain fills the storm drains faster than they can carry it away",
     "तेज़ बारिश नालों को उनकी क्षमता से तेज़ भर देती है"),
    ("drain.overflow", "complaint.waterlogging", 0, 60,
     "a surcharged drain backs up and spills onto the street",
     "भरा हुआ नाला उफनकर सड़क पर पानी फैला देता है"),
    ("drain.overflow", "complaint.road_damage", 0, 240,
     "water forced out of a full drain undermines the road beside it",
     "उफनते नाले का पानी बगल की सड़क को नीचे से खोखला कर देता है"),
    ("weather.rain", "complaint.road_damage", 0, 240,
     "standing water opens up potholes that residents then report",
     "जमा पानी से गड्ढे खुल जाते हैं जिनकी शिकायत लोग करते हैं"),
    ("weather.heat", "power.outage", 0, 180,
     "peak cooling load on a hot afternoon overloads distribution feeders",
     "गर्म दोपहर में कूलिंग लोड बढ़ने से बिजली फीडर पर दबाव आता है"),
    ("complaint.waterlogging", "power.outage", 0, 60,
     "water in a street-level substation or feeder pillar trips it",
     "सड़क के सबस्टेशन या फीडर में पानी जाने से बिजली जाती है"),
    ("complaint.waterlogging", "complaint.road_damage", 0, 240,
     "water under the surface breaks the road up",
     "सतह के नीचे पानी जाने से सड़क टूट जाती है"),
    ("power.outage", "traffic.signal_down", 0, 30,
     "a tripped feeder carrying signal circuits leaves junctions dark",
     "सिग्नल सर्किट वाला फीडर ट्रिप होने पर चौराहे अँधेरे रहते हैं"),
    ("power.outage", "complaint.streetlight", 0, 60,
     "the same dead feeder takes the street lights with it",
     "वही बंद फीडर स्ट्रीटलाइट भी बंद कर देता है"),
    ("complaint.smoke", "air.pm25", 0, 30,
     "burning close by pushes particulate readings up downwind",
     "पास में कुछ जलने से हवा में कण बढ़ जाते हैं"),
)

# ---- fixed values: category wording: noun en, noun hi, first-step en, first-step hi, later-step hi
CATEGORY_PHRASES = (
    ("weather.rain", "Heavy rain", "तेज़ बारिश",
     "Heavy rain started", "तेज़ बारिश शुरू हुई", "तेज़ बारिश शुरू हुई"),
    ("weather.heat", "Extreme heat", "अत्यधिक गर्मी",
     "Extreme heat set in", "अत्यधिक गर्मी शुरू हुई", "अत्यधिक गर्मी शुरू हुई"),
    ("air.pm25", "Poor air", "खराब हवा",
     "Air quality dropped", "हवा की गुणवत्ता गिरी", "हवा की गुणवत्ता गिरी"),
    ("power.outage", "A power cut", "बिजली कटौती",
     "Power went out", "बिजली चली गई", "बिजली चली गई"),
    ("traffic.signal_down", "A signal not working", "बंद सिग्नल",
     "A traffic signal went dark", "एक ट्रैफिक सिग्नल बंद हो गया", "एक ट्रैफिक सिग्नल बंद हो गया"),
    ("drain.overflow", "Overflowing drains", "उफनते नाले",
     "Storm drains started overflowing", "नाले उफनने लगे", "नाले उफनने लगे"),
    ("complaint.waterlogging", "Waterlogging", "जलभराव",
     "Residents reported waterlogging", "निवासियों ने जलभराव की शिकायत की", "जलभराव की शिकायत आई"),
    ("complaint.garbage", "Uncleared garbage", "कचरा",
     "Residents reported uncleared garbage", "निवासियों ने कचरा न उठने की शिकायत की", "कचरा न उठने की शिकायत आई"),
    ("complaint.streetlight", "A dark streetlight", "बंद स्ट्रीटलाइट",
     "A streetlight was reported dark", "एक स्ट्रीटलाइट बंद बताई गई", "स्ट्रीटलाइट बंद बताई गई"),
    ("complaint.road_damage", "Road damage", "सड़क खराब",
     "Residents reported road damage", "निवासियों ने सड़क खराब होने की शिकायत की", "सड़क खराब होने की शिकायत आई"),
    ("complaint.smoke", "Smoke or burning", "धुआँ",
     "Residents reported smoke", "निवासियों ने धुएं की शिकायत की", "धुएं की शिकायत आई"),
)

# ---- fixed values: headline endings by last category -------------------------------------
EFFECT_PHRASES = (
    ("complaint.waterlogging", "is causing waterlogging", "से जलभराव हो रहा है"),
    ("power.outage", "has cut power", "से बिजली गई है"),
    ("traffic.signal_down", "has left a signal dark", "से सिग्नल बंद है"),
    ("drain.overflow", "is overflowing the drains", "से नाले उफन रहे हैं"),
    ("complaint.road_damage", "has damaged the road", "से सड़क खराब हुई है"),
    ("complaint.streetlight", "has left a streetlight dark", "से स्ट्रीटलाइट बंद है"),
    ("air.pm25", "is worsening the air", "से हवा खराब हो रही है"),
)

# ---- fixed values: resident wording: category label en/hi, suggested action en/hi ---------
CATEGORY_LABELS = (
    ("weather.rain", "Heavy rain", "तेज़ बारिश"),
    ("weather.heat", "Extreme heat", "अत्यधिक गर्मी"),
    ("air.pm25", "Poor air", "खराब हवा"),
    ("power.outage", "Power cut", "बिजली कटौती"),
    ("traffic.signal_down", "Signal not working", "सिग्नल बंद"),
    ("drain.overflow", "Drain overflowing", "नाला उफान पर"),
    ("complaint.waterlogging", "Waterlogging", "जलभराव"),
    ("complaint.garbage", "Garbage not cleared", "कचरा नहीं उठा"),
    ("complaint.streetlight", "Streetlight out", "स्ट्रीटलाइट बंद"),
    ("complaint.road_damage", "Road damage", "सड़क खराब"),
    ("complaint.smoke", "Smoke or burning", "धुआँ या जलना"),
)
ACTIONS = (
    ("weather.rain", "Avoid low-lying roads nearby — they may be flooded.", "पास की नीची सड़कों से बचें — वहाँ पानी भर सकता है।"),
    ("complaint.waterlogging", "Avoid this area if you can — roads may be flooded.", "हो सके तो इस क्षेत्र से बचें — सड़कों पर पानी हो सकता है।"),
    ("power.outage", "Expect signals to be dark near here — drive carefully.", "पास में सिग्नल बंद हो सकते हैं — सावधानी से चलाएँ।"),
    ("traffic.signal_down", "Expect signals to be dark near here — drive carefully.", "पास में सिग्नल बंद हो सकते हैं — सावधानी से चलाएँ।"),
    ("drain.overflow", "Keep clear of open drains and underpasses nearby.", "पास के खुले नालों और अंडरपास से दूर रहें।"),
    ("complaint.smoke", "Keep windows closed if you're nearby.", "पास हैं तो खिड़कियाँ बंद रखें।"),
    ("air.pm25", "Limit outdoor activity if you're sensitive to air quality.", "हवा को लेकर संवेदनशील हैं तो बाहर कम रहें।"),
    ("weather.heat", "Stay hydrated and avoid the sun if you're nearby.", "पानी पीते रहें और धूप से बचें।"),
    ("complaint.garbage", "Being tracked — no action needed.", "नज़र रखी जा रही है — कोई कार्रवाई ज़रूरी नहीं।"),
    ("complaint.streetlight", "Being tracked — no action needed.", "नज़र रखी जा रही है — कोई कार्रवाई ज़रूरी नहीं।"),
    ("complaint.road_damage", "Drive slowly — the road surface is broken here.", "धीरे चलाएँ — यहाँ सड़क टूटी है।"),
)
FRAMING_EN = ("This situation links events that appear connected based on timing, location, "
              "and known cause-effect relationships. It is a possible link, not a confirmed one.")
FRAMING_HI = ("यह स्थिति उन घटनाओं को जोड़ती है जो समय, स्थान और ज्ञात कारण-प्रभाव संबंधों के "
              "आधार पर जुड़ी हुई दिखती हैं। यह एक संभावित कड़ी है, पुष्ट नहीं।")

# ---- fixed values: calibration sweep, loosest first --------------------------------------
RARE_THRESHOLDS = (5e-3, 2e-3, 1e-3, 5e-4, 2e-4, 1e-4, 5e-5, 1e-5, 1e-6, 0.0)

# ---- fixed value: radius of the earth ------------------------------------------------------
EARTH_RADIUS_KM = 6371.0088
