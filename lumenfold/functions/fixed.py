"""Word lists, lookup tables and thresholds that results depend on."""

# Fixed values. Years that a capture date may have.
MIN_YEAR, MAX_YEAR = 1990, 2026

# Fixed values. Patterns of dates in file names, in the order in which they are tried.
FILENAME_DATES = [
    r"(\d{4})[_-](\d{2})[_-](\d{2})",
    r"(\d{4})(\d{2})(\d{2})",
    r"BURST(\d{4})(\d{2})(\d{2})",
    r"PXL_(\d{4})(\d{2})(\d{2})",
    r"(\d{4})(\d{2})(\d{2})_\d{6}",
]
# Fixed values. Patterns of dates in directory names: day, month and year; dashed; a year alone.
DAY_DATE = r"(?i)(\d{1,2})\s+(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\w*\s+(\d{4})"
DASHED_DATE = r"(\d{4})[_-](\d{2})[_-](\d{2})"
YEAR_ALONE = r"\b(199\d|20[012]\d)\b"

# Fixed values. Extensions of media files.
IMAGE_EXTENSIONS = ["jpg", "jpeg", "png", "gif", "heic", "webp", "bmp", "tiff", "tif", "arw", "dng", "cr2", "nef", "orf", "rw2"]
VIDEO_EXTENSIONS = ["mp4", "mov", "avi", "mkv", "3gp", "wmv", "flv", "webm"]

# Fixed values. Country names by code.
COUNTRY_NAMES = {
    "US": "USA", "GB": "United Kingdom", "FR": "France", "DE": "Germany", "ES": "Spain", "IT": "Italy", "JP": "Japan",
    "AU": "Australia", "NZ": "New Zealand", "CA": "Canada", "NL": "Netherlands", "BE": "Belgium", "AT": "Austria",
    "CH": "Switzerland", "SE": "Sweden", "NO": "Norway", "DK": "Denmark", "FI": "Finland", "PT": "Portugal", "IE": "Ireland",
    "GR": "Greece", "TR": "Turkey", "TH": "Thailand", "VN": "Vietnam", "ID": "Indonesia", "MY": "Malaysia", "SG": "Singapore",
    "PH": "Philippines", "IN": "India", "CN": "China", "KR": "South Korea", "TW": "Taiwan", "HK": "Hong Kong", "MX": "Mexico",
    "BR": "Brazil", "AR": "Argentina", "CL": "Chile", "CO": "Colombia", "PE": "Peru", "ZA": "South Africa", "EG": "Egypt",
    "MA": "Morocco", "KE": "Kenya", "TZ": "Tanzania", "IS": "Iceland", "HR": "Croatia", "CZ": "Czech Republic", "PL": "Poland",
    "HU": "Hungary", "RO": "Romania", "RS": "Serbia", "ME": "Montenegro", "BA": "Bosnia", "SK": "Slovakia", "SI": "Slovenia",
    "LT": "Lithuania", "LV": "Latvia", "EE": "Estonia", "MT": "Malta", "CY": "Cyprus", "LU": "Luxembourg", "AD": "Andorra",
    "BG": "Bulgaria",
}
# Fixed values. Country codes by upper-case name where the name differs from the table above, or is not in it.
COUNTRY_ALIASES = {"UNITED STATES": "US", "UK": "GB", "CZECHIA": "CZ", "ALBANIA": "AL", "NORTH MACEDONIA": "MK", "MOLDOVA": "MD", "UKRAINE": "UA"}

# Fixed values. Countries whose albums count as holidays.
HOLIDAY_COUNTRIES = [
    "Japan", "France", "Spain", "Italy", "Greece", "Austria", "Germany", "Switzerland", "Portugal", "Croatia", "Iceland", "Norway",
    "Sweden", "Thailand", "Indonesia", "Vietnam", "Australia", "New Zealand", "USA", "Canada", "Mexico", "Brazil", "Argentina",
    "Peru", "Morocco", "South Africa", "Kenya", "Tanzania", "Egypt", "Bali", "Singapore", "Malaysia", "Philippines", "India",
    "China", "South Korea", "Hong Kong", "Taiwan", "Turkey", "Czech Republic", "Poland", "Hungary", "Romania", "Serbia",
    "Montenegro", "Bosnia", "Belgium", "Netherlands", "Ireland", "Malta", "Cyprus", "Luxembourg",
]
# Fixed values. Scene types that make an album a holiday.
HOLIDAY_SCENES = ["holiday", "landscape", "nature", "hiking", "beach"]

# Fixed values. Words of an album's name that mark travel.
TRAVEL_WORDS = [
    "holiday", "trip", "visit", "tour", "explore", "walk", "hike", "summer", "winter", "spring", "autumn", "adventure", "break",
    "weekend", "journey", "japan", "spain", "france", "italy", "germany", "thailand", "bali", "greece", "amsterdam", "barcelona",
    "paris", "london", "edinburgh", "iceland", "norway", "sweden", "austria", "portugal", "zealand", "australia", "canada",
    "scotland", "ireland", "wales", "croatia", "turkey", "morocco", "peru", "mexico", "usa", "texas", "colorado", "california",
    "florida", "tokyo", "kyoto", "osaka", "berlin", "rome", "venice", "florence", "prague", "budapest", "lisbon", "athens",
    "dubai", "singapore", "hongkong", "maldives", "safari", "beach", "mountain", "ski", "snow",
]

# Fixed values. Prefixes of numbered camera files.
NUMBERED_PREFIXES = ["IMG", "DSC", "DSCN", "DSCF", "P", "PIC", "PHOTO", "MVI", "VID", "MOV"]

# Fixed values. Control points (input, output) of the red, green and blue tone curves of each mood.
TONE_CURVES = {
    "golden_hour": ([(0, 18), (64, 74), (128, 140), (192, 212), (255, 255)], [(0, 20), (64, 72), (128, 136), (192, 200), (255, 248)], [(0, 32), (64, 68), (128, 118), (192, 162), (255, 210)]),
    "moody": ([(0, 8), (64, 56), (128, 120), (192, 186), (255, 248)], [(0, 16), (64, 64), (128, 124), (192, 184), (255, 244)], [(0, 45), (64, 90), (128, 142), (192, 194), (255, 238)]),
    "vibrant": ([(0, 12), (64, 68), (128, 136), (192, 208), (255, 255)], [(0, 18), (64, 78), (128, 142), (192, 202), (255, 252)], [(0, 28), (64, 68), (128, 124), (192, 172), (255, 218)]),
    "dramatic": ([(0, 4), (64, 52), (128, 128), (192, 208), (255, 255)], [(0, 6), (64, 55), (128, 126), (192, 196), (255, 250)], [(0, 10), (64, 56), (128, 120), (192, 178), (255, 230)]),
    "soft": ([(0, 32), (64, 82), (128, 140), (192, 198), (255, 248)], [(0, 28), (64, 78), (128, 136), (192, 194), (255, 244)], [(0, 42), (64, 86), (128, 136), (192, 192), (255, 238)]),
    "flat": ([(0, 15), (64, 68), (128, 133), (192, 200), (255, 255)], [(0, 22), (64, 74), (128, 133), (192, 195), (255, 250)], [(0, 35), (64, 78), (128, 128), (192, 180), (255, 225)]),
}
