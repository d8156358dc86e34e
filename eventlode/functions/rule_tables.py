"""Rule tables. All lists of this module are fixed values: they must be these, in this order, for right results."""

from __future__ import annotations

# --- fixed values: categories of foreign taxonomies (source, foreign name, own category)
CATEGORY_MAPS: dict[str, dict[str, str]] = {
    "ticketmaster_segment": {"KZFzniwnSyZfZ7v7nJ": "Music", "KZFzniwnSyZfZ7v7na": "Art", "KZFzniwnSyZfZ7v7nE": "Sports", "KZFzniwnSyZfZ7v7n1": "Comedy", "KZFzniwnSyZfZ7v7nI": "Film"},
    "ticketmaster_genre": {"Classical": "Music", "Opera": "Music", "Jazz": "Music", "Rock": "Music", "Pop": "Music", "R&B": "Music", "Hip-Hop/Rap": "Music", "Country": "Music", "Electronic": "Music", "Comedy": "Comedy", "Dance": "Dance", "Theatre": "Art", "Musical": "Art", "Film": "Film", "Family": "Festival", "Circus & Specialty Acts": "Festival"},
    "eventbrite": {
        "Music": "Music", "Business & Professional": "Career", "Food & Drink": "Food & Drink", "Community & Culture": "Festival", "Performing & Visual Arts": "Art", "Film, Media & Entertainment": "Film", "Sports & Fitness": "Sports", "Health & Wellness": "Fitness",
        "Science & Technology": "Technology", "Travel & Outdoor": "Outdoor", "Charity & Causes": "Charity", "Religion & Spirituality": "Religious", "Family & Education": "Academic", "Seasonal & Holiday": "Festival", "Government & Politics": "Political", "Fashion & Beauty": "Art",
        "Home & Lifestyle": "Home & Garden", "Auto, Boat & Air": "Automotive", "Hobbies & Special Interest": "Workshop", "School Activities": "Academic",
    },
    "seatgeek": {"concert": "Music", "sports": "Sports", "theater": "Art", "comedy": "Comedy", "dance_performance_tour": "Dance", "family": "Festival", "film": "Film", "literary": "Literature", "food_and_drink": "Food & Drink"},
    "predicthq": {"concerts": "Music", "conferences": "Technology", "expos": "Technology", "festivals": "Festival", "performing-arts": "Art", "community": "Charity", "sports": "Sports", "academic": "Academic", "politics": "Political", "religion": "Religious", "outdoor": "Outdoor"},
    "luma": {"Technology": "Technology", "Networking": "Career", "Education": "Workshop", "Music": "Music", "Art": "Art", "Food": "Food & Drink", "Sports": "Sports", "Fitness": "Fitness", "Gaming": "Gaming", "Charity": "Charity", "Politics": "Political", "Religion": "Religious", "Automotive": "Automotive", "Craft": "Craft", "Outdoor": "Outdoor", "Pet": "Pet"},
}

# --- fixed values: event type by tag, first group wins
TAG_TYPES: list[tuple[str, list[str]]] = [
    ("Symphony Orchestral Performances", ["symphony orchestra", "philharmonic", "chamber orchestra", "orchestral music", "symphonic"]),
    ("Fully Staged Opera", ["opera", "operetta"]),
    ("Baroque Orchestras", ["baroque", "early music"]),
    ("String Quartets", ["string quartet", "chamber music", "chamber ensemble"]),
    ("Choral Performance", ["choral", "choir", "a cappella"]),
    ("Jazz Concert", ["jazz", "bebop", "swing", "bossa nova", "smooth jazz", "fusion jazz", "blues"]),
    ("Electronic / DJ Set", ["techno", "house", "trance", "edm", "drum and bass", "dubstep", "electronic", "electronica", "ambient", "breakbeat", "rave", "psytrance", "industrial", "experimental electronic"]),
    ("Hip-Hop / Rap Concert", ["hip-hop", "hip hop", "rap", "trap", "drill", "grime"]),
    ("R&B / Soul Concert", ["r&b", "soul", "neo-soul", "funk", "motown", "rhythm and blues"]),
    ("Reggae / Calypso Concert", ["reggae", "dancehall", "ska", "dub", "calypso"]),
    ("Latin Concert", ["latin", "salsa", "reggaeton", "cumbia", "bachata", "bossa nova", "samba", "latin pop"]),
    ("Country Concert", ["country", "bluegrass", "americana", "folk rock", "folk"]),
    ("Gospel Concert", ["gospel", "christian music", "worship", "contemporary christian"]),
    ("Rock Concert", ["heavy metal", "death metal", "black metal", "thrash metal", "metal"]),
    ("Rock Concert", ["rock", "indie", "alternative", "punk", "grunge", "post-rock", "emo", "hard rock", "classic rock"]),
    ("Pop Concert", ["pop", "dance-pop", "synth-pop", "k-pop", "j-pop"]),
    ("Comedy Club Headliners", ["stand-up comedy", "comedy", "comedian", "satirical"]),
    ("Broadway Show", ["musical theatre", "musical theater", "broadway", "west end"]),
    ("Play / Drama", ["theatre", "theater", "drama"]),
    ("Classical Ballet", ["ballet"]),
    ("Modern Dance", ["contemporary dance", "modern dance"]),
    ("Flamenco", ["flamenco"]),
]

# --- fixed values: event type by genre, a part of any genre is enough, first rule wins
GENRE_TYPES: list[tuple[str, list[str]]] = [
    ("Electronic / DJ Set", ["edm", "electronic", "techno", "house", "trance", "drum and bass", "dubstep", "ambient"]),
    ("Hip-Hop / Rap Concert", ["hip hop", "rap", "trap", "grime"]),
    ("R&B / Soul Concert", ["r&b", "soul", "neo soul"]),
    ("Jazz Concert", ["jazz", "bebop", "swing"]),
    ("Blues Concert", ["blues"]),
    ("Classical Concert", ["classical"]),
    ("Opera", ["opera"]),
    ("Classical Concert", ["orchestral", "chamber music", "choral"]),
    ("Country Concert", ["country", "bluegrass", "americana"]),
    ("Folk / Acoustic Concert", ["folk", "singer-songwriter", "acoustic"]),
    ("Reggae Concert", ["reggae", "dancehall"]),
    ("Rock Concert", ["metal", "punk", "hardcore", "rock", "indie", "alternative", "grunge"]),
    ("Concert", ["pop", "k-pop", "latin", "reggaeton"]),
    ("Stand-Up Comedy", ["comedy"]),
    ("Spoken Word", ["spoken word"]),
]
GENRE_CATEGORIES: list[tuple[str, list[str]]] = [("Comedy", ["comedy", "spoken word"]), ("Classical", ["classical", "opera", "orchestral", "choral"])]
GENRE_FORMATS: dict[str, tuple[str, list[str]]] = {
    "Rock": ("Music", ["rock"]), "Pop": ("Music", ["pop"]), "Jazz": ("Music", ["jazz"]), "Hip-Hop": ("Music", ["hip-hop", "hip hop", "rap"]), "Latin": ("Music", ["latin"]), "Country": ("Music", ["country"]),
    "Classical": ("Music", ["classical", "symphony", "opera", "concerto", "recital", "baroque", "renaissance", "string quartet", "piano trio", "woodwind"]),
    "Electronic": ("Music", ["electronic", "dj set"]), "World": ("Music", ["world", "reggae", "gospel"]), "Comedy": ("Comedy", []),
}

# --- fixed values: event type by words of the venue's name and city
VENUE_TYPES: list[tuple[str, list[str]]] = [
    ("Jazz Concert", ["jazz"]), ("Rock Concert", ["rock"]), ("Hip-Hop / Rap Concert", ["hip hop", "hip-hop"]), ("Comedy Show", ["comedy"]), ("Fully Staged Opera", ["opera"]),
    ("Symphony Orchestral Performances", ["symphony", "orchestra", "philharmon"]), ("Electronic / DJ Set", ["electronic", "techno"]), ("Pop Concert", ["pop"]), ("Latin Concert", ["latin"]),
    ("Gospel Concert", ["gospel"]), ("Country Concert", ["country"]), ("R&B / Soul Concert", ["blues", "soul", "r&b"]), ("Reggae / Calypso Concert", ["reggae"]),
]

# --- fixed values: event type by words of " name description "; spaces within the words count
NAME_TYPES: list[tuple[str, list[str]]] = [
    ("Baseball Game", ["baseball", " mlb "]), ("Basketball Game", ["basketball", " nba "]), ("Hockey Game", ["hockey", " nhl "]), ("Soccer Match", ["soccer", " mls "]), ("American Football Game", [" nfl "]),
    ("Tennis Match", ["tennis", " atp ", " wta "]), ("Golf Tournament", ["golf", " pga "]), ("Boxing / MMA Event", ["boxing", " mma ", " ufc "]), ("Wrestling Event", ["wrestling", " wwe "]),
    ("Marathons", ["marathon", "triathlon"]), ("Cycling Races", ["cycling"]), ("Yoga Retreats", ["yoga"]), ("CrossFit Competitions", ["crossfit"]), ("Hiking Meetups", ["hiking"]), ("Rock Climbing Competitions", ["rock climbing"]),
    ("Symphony Orchestral Performances", ["symphony", "orchestra", "philharmonic"]), ("Concerto Performances", ["concerto"]), ("String Quartets", ["string quartet", "chamber music"]), ("Piano Trios", ["piano trio"]),
    ("Fully Staged Opera", ["opera"]), ("Baroque Orchestras", ["baroque", "early music"]), ("Renaissance Vocal Ensembles", ["renaissance"]), ("Solo Recitals", ["recital"]), ("Jazz Concert", ["jazz"]),
    ("Hip-Hop / Rap Concert", ["hip-hop", "hip hop", " rap ", " trap "]), ("Rock Concert", ["rock concert", " rock ", " metal ", " punk ", " grunge ", "indie rock", "indie band"]), ("Pop Concert", [" pop concert", "pop music"]),
    ("Electronic / DJ Set", ["electronic", " dj set", " dj ", "techno", " edm ", "house music", " trance "]), ("R&B / Soul Concert", ["r&b", " soul ", " blues ", " funk "]), ("Gospel Concert", ["gospel"]),
    ("Country Concert", ["country", "bluegrass"]), ("Concert", ["folk music", "folk band"]), ("Latin Concert", ["latin", "salsa", "cumbia", " bossa "]), ("Reggae / Calypso Concert", ["reggae", " ska "]),
    ("Classical Ballet", ["ballet"]), ("Flamenco", ["flamenco"]), ("Bharatanatyam", ["bharatanatyam"]), ("Irish Step Dance", ["irish step"]), ("African Dance", ["african dance"]), ("Modern Dance", ["contemporary dance"]),
    ("Open Mic Nights", ["open mic"]), ("Comedy Club Headliners", ["stand-up", "stand up"]), ("Short-Form Improv", ["improv"]), ("Sketch Comedy Performances", ["sketch comedy"]),
    ("International Film Festivals", ["film festival"]), ("Art House Cinema Screenings", ["film screening"]), ("Red Carpet Premieres", ["premiere"]), ("Director Retrospectives", ["retrospective"]),
    ("Book Launches", ["book launch"]), ("Author Talks", ["author talk"]), ("Poetry Slams", ["poetry slam"]), ("Book Clubs", ["book club"]), ("Panel Discussions", ["literary"]),
    ("Wine Tastings", ["wine tasting"]), ("Craft Beer Events", ["beer festival"]), ("Beer Samplings", ["beer tasting"]), ("Farmers Markets", ["farmers market"]), ("Chef Demonstrations", ["food festival"]), ("Brewery Tours", ["brewery"]), ("Vineyard Tours", ["vineyard"]),
    ("Art Fairs", ["art fair"]), ("Museum Public Opening Receptions", ["gallery opening"]), ("Murals", ["mural"]), ("Broadway Show", ["broadway"]), ("Play / Drama", [" play ", "theatre", "theater"]),
    ("Startup Showcases", ["hackathon", "startup"]), ("AI Tech Conferences", [" ai "]), ("Cybersecurity Conferences", ["cybersecurity"]), ("AI Tech Conferences", ["tech conference"]), ("Consumer Electronics Shows", ["consumer electronics"]),
    ("Job Fairs", ["job fair", "career fair"]), ("Networking Expos", ["networking"]), ("Formal Fundraising Galas", ["gala"]), ("Fundraising Dinners", ["fundrais"]), ("Benefit Concerts", ["benefit concert"]),
    ("Charity Walks", ["charity walk"]), ("Charity Runs", ["charity run"]), ("Charity Auctions", ["auction"]), ("Campaign Events", ["rally"]), ("Protests", ["protest"]), ("Marches", [" march "]), ("Town Hall Meetings", ["town hall"]),
    ("eSports Tournaments", ["esport"]), ("Board Game Conventions", ["board game"]), ("Video Game Expos", ["video game"]), ("Tabletop RPG Events", [" rpg "]), ("Auto Expos", ["car show", "auto expo"]), ("Vintage Car Exhibitions", ["vintage car"]),
    ("Pride Parades", ["pride parade"]), ("Cultural Celebrations", [" parade"]), ("Handmade Goods Markets", ["craft fair"]), ("Artisan Events", ["makers market", "artisan market"]),
    ("Dog Shows", ["dog show"]), ("Cat Shows", ["cat show"]), ("Pet Adoption Events", ["pet adoption"]), ("Camping Rallies", ["camping"]), ("Survival Workshops", ["survival"]),
]

# --- fixed values: event type where only the category is known
CATEGORY_TYPES: dict[str, str] = {
    "Music": "Concert", "Art": "Commercial Gallery Exhibitions", "Comedy": "Open Mic Nights", "Dance": "Modern Dance", "Film": "Art House Cinema Screenings", "Fitness": "Marathons", "Sports": "Sports Event", "Festival": "Multi-Genre Music Festivals",
    "Food & Drink": "Farmers Markets", "Technology": "AI Tech Conferences", "Literature": "Author Talks", "Charity": "Formal Fundraising Galas", "Political": "Campaign Events", "Religious": "Church Services", "Career": "Networking Expos",
    "Workshop": "Photography Workshops", "Academic": "Guest Speaker Events", "Automotive": "Auto Expos", "Craft": "Handmade Goods Markets", "Parade": "Cultural Celebrations", "Theme Park": "Seasonal Theme Park Celebrations", "Outdoor": "Hiking Meetups",
    "Gaming": "Board Game Conventions", "Pet": "Pet Adoption Events", "Home & Garden": "Home Improvement Expos",
}

# --- fixed values: event type by keyword; the order of search is that of the longest keyword
KEYWORD_TYPES: list[tuple[str, list[str]]] = [
    ("Jazz Concert", ["jazz", "blues", "bebop", "swing", "coltrane"]), ("Hip-Hop / Rap Concert", ["hip-hop", "hip hop", "rap", "trap", "drill"]), ("Rock Concert", ["rock concert", "punk", "metal", "grunge"]), ("Pop Concert", ["pop concert"]),
    ("Electronic / DJ Set", ["dj set", "dj ", " dj", "electronic", "edm", "techno", "house music", "rave", "club night", "dnb", "drum and bass", "trance", "psytrance", "b2b", "all-night long", "warehouse party"]),
    ("R&B / Soul Concert", ["r&b", " soul ", "neo-soul", "motown"]), ("Country Concert", ["country music", "bluegrass", "americana"]), ("Latin Concert", ["salsa", "reggaeton", "cumbia", "bachata", "latin music"]),
    ("Reggae / Calypso Concert", ["reggae", "calypso", "dancehall", "ska"]), ("Gospel Concert", ["gospel", "christian music", "worship"]), ("Symphony Orchestral Performances", ["symphony", "philharmonic", "orchestral"]),
    ("Fully Staged Opera", ["opera ", " opera"]), ("String Quartets", ["string quartet", "chamber music"]), ("Baroque Orchestras", ["baroque", "early music"]), ("Open Mic Nights", ["open mic", "open-mic"]),
    ("Comedy Club Headliners", ["stand-up", "standup", "stand up comedy", "comedy club"]), ("Short-Form Improv", ["improv", "short-form improv"]), ("Sketch Comedy Performances", ["sketch comedy", "sketch show"]), ("One-Person Shows", ["one-person show", "one-man show", "one-woman show"]),
    ("Classical Ballet", ["ballet", "nutcracker", "swan lake"]), ("Contemporary Ballet", ["contemporary ballet"]), ("Modern Dance", ["modern dance", "contemporary dance"]), ("Flamenco", ["flamenco"]), ("Irish Step Dance", ["irish dance", "riverdance"]),
    ("Broadway Show", ["broadway", "off-broadway", "west end", "musical theatre", "musical theater"]), ("Play / Drama", [" play ", "theatre", "theater", "staged reading", "drama"]), ("Special Museum Exhibitions", ["museum exhibition", "museum exhibit"]),
    ("Interactive Art Installations", ["installation", "immersive art"]), ("Art Fairs", ["art fair"]), ("Red Carpet Premieres", ["premiere", "red carpet"]), ("International Film Festivals", ["film festival"]),
    ("Art House Cinema Screenings", ["arthouse", "art house cinema", "indie film"]), ("Community Film Screenings", ["film screening", "outdoor film", "movie screening"]), ("Wine Tastings", ["wine tasting", "wine pairing"]), ("Craft Beer Events", ["craft beer", "beer festival", "brewery event"]),
    ("Street Food Fairs", ["street food", "food fair", "food market"]), ("Farmers Markets", ["farmers market", "farmer's market"]), ("Marathons", ["marathon", "half marathon", " 5k", " 10k", "fun run"]), ("Yoga Retreats", ["yoga class", "pilates", "meditation retreat"]),
    ("Cycling Races", ["cycling race", "bike race"]), ("AI Tech Conferences", ["ai conference", "machine learning", "artificial intelligence"]), ("Startup Showcases", ["startup", "demo day", "pitch night", "hackathon"]), ("Author Talks", ["author talk", "book talk", "author reading"]),
    ("Poetry Slams", ["poetry slam", "spoken word"]), ("Book Launches", ["book launch", "book signing"]), ("Formal Fundraising Galas", ["fundraising gala", "charity gala", "benefit gala"]), ("Benefit Concerts", ["benefit concert", "charity concert"]),
    ("eSports Tournaments", ["esports", "e-sports", "gaming tournament"]), ("Hiking Meetups", ["hiking", " hike ", "trail walk", "nature walk"]), ("Genre-Specific Music Festivals", ["music festival"]), ("Pride Parades", ["pride parade", "lgbtq parade"]),
    ("Holiday Parades", ["holiday parade", "thanksgiving parade"]), ("Cultural Celebrations", ["cultural festival", "cultural celebration"]),
]

# --- fixed values: patterns that refine the generic type "Concert"; case does not count, first type wins
REFINED_TYPES: list[tuple[str, list[str]]] = [
    ("Symphony Orchestral Performances", [r"\borchestra\b", r"\bsymphon", r"\bphilharmon", r"\bchamber music\b", r"\bquartet\b", r"\bquintet\b", r"\bopera\b", r"\bconcerto\b", r"\bchamber orch", r"\bstring ensemble\b", r"\bchoral\b", r"\bjuilliard\b", r"\bcarnegie\b.*classic", r"\bclassical\b", r"\bmaestro\b", r"\bsinfoni"]),
    ("Electronic / DJ Set", [r"\bedm\b", r"\belectronic\b", r"\bhouse music\b", r"\btechno\b", r"\bdrums?\s*&\s*bass\b", r"\bd&b\b", r"\bdubstep\b", r"\bsynth\b", r"\bdj\s+set\b", r"\brave\b", r"\bnight\s*club\b", r"\bdisco\b", r"\bdance\s*music\b", r"\belectro\b", r"\btrance\b", r"\bambient\b", r"\bsynthony\b", r"\b808\b", r"\bbass\s+music\b"]),
    ("Jazz Concert", [r"\bjazz\b", r"\bblues\b", r"\bswing\b", r"\bbebop\b", r"\bfusion\b", r"\bsoul\s*jazz\b", r"\bsmooth\s*jazz\b", r"\bbig\s*band\b", r"\btrio\b.*jazz", r"\bjazz\s*club\b"]),
    ("Hip-Hop / Rap Concert", [r"\bhip.?hop\b", r"\brap\b", r"\btrapp?\b", r"\bgrime\b", r"\br&b\s*&\s*hip", r"\bfreestyle\b", r"\blyricist\b"]),
    ("Rock Concert", [r"\brock\b", r"\bmetal\b", r"\bpunk\b", r"\bgrunge\b", r"\bindier?\b", r"\balternative\b", r"\bemo\b", r"\bhardcore\b", r"\bpost.?rock\b", r"\bpsychedelic\b", r"\bstoner\b", r"\bprog(ressive)?\b", r"\bfolkrock\b", r"\bblues.?rock\b"]),
    ("Pop Concert", [r"\bpop\b", r"\bpop\s*music\b", r"\bindipop\b", r"\bdream\s*pop\b", r"\bsynth.?pop\b", r"\bpower\s*pop\b", r"\bk-pop\b", r"\bj-pop\b", r"\b90s\b", r"\b2000s\b", r"\b00s\b", r"\bnineties\b"]),
    ("R&B / Soul Concert", [r"\br&b\b", r"\bsoul\b", r"\bfunk\b", r"\bmotown\b", r"\bgospel\b", r"\bnew\s*jack\b", r"\bneo.?soul\b"]),
    ("Country Concert", [r"\bcountry\b", r"\bbluegrass\b", r"\bamericana\b", r"\bfiddl", r"\bnashville\b", r"\bwestern\s*swing\b", r"\balt.?country\b"]),
    ("Latin Concert", [r"\blatin\b", r"\bsalsa\b", r"\bregaeton\b", r"\bflamenco\b", r"\bbachata\b", r"\bcumbia\b", r"\btango\b", r"\bbolero\b", r"\bmerengue\b", r"\bbossa\s*nova\b"]),
    ("Reggae / Calypso Concert", [r"\breggae\b", r"\bdancehall\b", r"\bska\b", r"\bcalypso\b", r"\bafrobeat\b", r"\bgospel\s*reggae\b"]),
    ("Comedy Club Headliners", [r"\bstandup\b", r"\bstand.?up\s*com", r"\bcomedy\s*(show|night|tour)\b", r"\bcomedi[an]", r"\bimprov\b", r"\bsketch\s*com"]),
    ("Ballet Performance", [r"\bballet\b", r"\bdance\s*show\b", r"\bdance\s*perform", r"\bcontemporary\s*dance\b", r"\bchoreograph"]),
    ("Play / Drama", [r"\btheater\b", r"\btheatre\b", r"\bplay\b.*stage", r"\bbroadway\b", r"\boff.?broadway\b", r"\bmusical\b", r"\bdrama\b", r"\bmonologue\b", r"\bstranger things\b", r"\bhamilton\b", r"\bwicked\b", r"\blion king\b", r"\bphantom of the opera\b", r"\bshen yun\b", r"\bshadow.*first\b", r"\btwo strangers\b"]),
    ("Special Museum Exhibitions", [r"\bmuseum\b", r"\bexhibit(ion)?\b", r"\binstallation\b", r"\bmoca\b", r"\bmoma\b", r"\bsmithsonian\b", r"\bmetropolitan\b", r"\btour experience\b", r"\bbuilding tour\b", r"\btussauds\b", r"\bwax\s*museum\b", r"\bprehistoric\b", r"\bdinosaur\b", r"\bplanetarium\b", r"\billusion\s*museum\b", r"\btwist\s*museum\b", r"\bnatural\s*history\b", r"\bscience\s*museum\b", r"\bgift\s*card\s*redemption\b"]),
    ("Commercial Gallery Exhibitions", [r"\bgallery\b", r"\bartwork\b", r"\bart show\b", r"\bbanksy\b", r"\bpop.?up\s*art\b"]),
    ("Artisan Events", [r"\bcrafting\b", r"\bcraft\s*(class|workshop|fair|session)\b", r"\bworkshop\b", r"\bpottery\b", r"\bpainting\s*class\b", r"\bceramic\b", r"\bknitting\b", r"\bsewing\b"]),
    ("Interactive Art Installations", [r"\bbubble show\b", r"\bgazillion\b", r"\bkids\s*(show|concert|event)\b", r"\bfamily\s*(show|event|fun)\b", r"\bpuppet\b"]),
    ("Theme Park Nighttime Shows", [r"\blondon\s*eye\b", r"\bferris\s*wheel\b", r"\btower\s*of\s*london\b", r"\bbuckingham\s*palace\b", r"\bshard\b.*view", r"\bskygarden\b", r"\bobservation\s*deck\b", r"\battraction\b.*ticket", r"\bstandard\s*entr(y|ance)\b", r"\bdisney\s*on\s*ice\b", r"\bice\s*show\b"]),
]

# --- fixed values: sources of one type, and patterns for a source with texts in two languages
SOURCE_TYPES: dict[str, tuple[str, str]] = {"barby": ("Music", "Concert"), "tel_aviv_venues": ("Music", "Concert"), "cameri": ("Art", "Play / Drama")}
LOCAL_TYPES: list[tuple[str, str, list[str]]] = [
    ("Art", "Play / Drama", [r"תיאטרון", r"תאטרון", r"מחזה", r"הצגה", r"theatre", r"theater", r"play\b", r"drama", r"broadway", r"מונולוג", r"קומדיה\s*מוזיקלית"]),
    ("Music", "Electronic / DJ Set", [r"rave", r"dj\s*set", r"electornic", r"edm", r"techno", r"house", r"מסיבה", r"ריקוד"]),
    ("Music", "Jazz Concert", [r"jazz", r"ג'אז", r"blues"]),
    ("Music", "Classical Concert", [r"orchestra", r"תזמורת", r"symphony", r"סימפוני", r"פילהרמונ", r"chamber", r"quartet", r"trio\b"]),
    ("Comedy", "Comedy Club Headliners", [r"stand.?up", r"comedy", r"קומדי", r"סטנד.?אפ", r"עומד\s*על\s*הבמה"]),
    ("Dance", "Ballet Performance", [r"ballet", r"בלט", r"מחול", r"dance\s*show", r"כורא"]),
    ("Music", "Concert", [r"לייב", r"live\b", r"הופעה", r"מופע", r"concert", r"פסטיבל", r"festival", r"גיטרה", r"תופים", r"קלידים"]),
]

# --- fixed values: patterns that confirm a symphony, and those that correct what is none (the first confirming pattern is as it must be)
CONFIRMED: list[str] = [
    r"\bsymphon\b", r"\bphilharmon\b", r"\bchamber\s*orchestra\b", r"\bstring\s*(quartet|ensemble)\b", r"\bconcerto\b", r"\boverture\b", r"\bopus\b", r"\bbeethoven\b", r"\bmozart\b", r"\bbach\b", r"\bchopins?\b", r"\bschubert\b", r"\bbrahms\b",
    r"\bvivaldi\b", r"\bhandel\b", r"\btchaikovsky\b", r"\bby candlelight\b", r"\bclassical\s*music\b", r"\bneoclassical\b", r"\boratorio\b", r"\bcantata\b", r"\bchamber\s*music\b", r"\bchamber\s*society\b",
]
CORRECTED: list[tuple[str, str, list[str]]] = [
    ("Art", "Play / Drama", [r"\bphantom of the opera\b", r"\bbroadway\b", r"\bmusical\b", r"\boff.?broadway\b", r"\btheatre\b", r"\btheater\b", r"\bwicked\b", r"\bhamilton\b", r"\blion king\b", r"\bshen yun\b", r"\bstomp\b"]),
    ("Music", "Jazz Concert", [r"\bjazz\b", r"\bfunk\b.*\borchest", r"\borchest.*\bfunk\b", r"\bbig\s*band\b", r"\bswing\b", r"\bblues\b.*\borchest", r"\bjazz.*\bquartet\b", r"\bjazz.*\bquintet\b", r"\bjazz.*\btrio\b", r"\btribute.*jazz\b", r"\bjazz.*tribute\b", r"\bgerry\s*mulligan\b", r"\bmingus\b", r"\bellington\b"]),
    ("Music", "Electronic / DJ Set", [r"\bballet\b.*electronic", r"\brave\b", r"\bedm\b", r"\bhouse\s*music\b", r"\btechno\b", r"\belectronic.*dance\b", r"\bdance.*party\b", r"\bindie\s*dance\b"]),
    ("Music", "Rock Concert", [r"\brock\b", r"\bindier?\b", r"\bpunk\b", r"\bmetal\b", r"\balternative\b", r"\bemo\b", r"\bgrunge\b"]),
    ("Music", "R&B / Soul Concert", [r"\bsoul\b", r"\br&b\b", r"\bfunk\b", r"\bmotown\b", r"\bteddy\s*pendergrass\b", r"\bgospel\b"]),
    ("Music", "Pop Concert", [r"\bpop\b", r"\bindipop\b", r"\bsynth.?pop\b"]),
    ("Music", "Country Concert", [r"\bcountry\b", r"\bbluegrass\b", r"\bamericana\b"]),
    ("Music", "Latin Concert", [r"\blatin\b", r"\bsalsa\b", r"\btango\b", r"\bflamenco\b"]),
    ("Comedy", "Comedy Club Headliners", [r"\bcomedy\b", r"\bstand.?up\b", r"\bcomedi[an]\b", r"\bimprov\b"]),
]

# --- fixed values: sports by words of "X vs Y" names, and by league label
VERSUS_SPORTS: list[tuple[str, str, str]] = [
    ("baseball", "Baseball", "Baseball Game"), ("softball", "Baseball", "Baseball Game"), ("basketball", "Basketball", "Basketball Game"), ("hockey", "Ice Hockey", "Hockey Game"),
    ("football", "American Football", "American Football Game"), ("soccer", "Soccer", "Soccer Match"), ("tennis", "Tennis", "Tennis Match"),
]
SEGMENT_SPORTS: list[tuple[str, str]] = [("baseball", "Baseball"), ("softball", "Baseball"), ("basketball", "Basketball"), ("hockey", "Ice Hockey"), ("football", "American Football"), ("soccer", "Soccer"), ("tennis", "Tennis"), ("golf", "Golf")]
LEAGUE_SPORTS: dict[str, tuple[str, str]] = {
    "NBA": ("Basketball", "Basketball Game"), "WNBA": ("Basketball", "Basketball Game"), "NHL": ("Ice Hockey", "Hockey Game"), "NFL": ("American Football", "American Football Game"), "MLS": ("Soccer", "Soccer Match"), "MLB": ("Baseball", "Baseball Game"),
    "AFL": ("Australian Football", "Sports Event"), "NRL": ("Rugby League", "Sports Event"), "NBL": ("Basketball", "Basketball Game"), "CFL": ("Canadian Football", "American Football Game"), "EuroLeague": ("Basketball", "Basketball Game"), "EuroCup": ("Basketball", "Basketball Game"),
    "Premier League": ("Soccer", "Soccer Match"), "Bundesliga": ("Soccer", "Soccer Match"), "La Liga": ("Soccer", "Soccer Match"), "Serie A": ("Soccer", "Soccer Match"), "Ligue 1": ("Soccer", "Soccer Match"), "Eredivisie": ("Soccer", "Soccer Match"),
    "UEFA Champions League": ("Soccer", "Soccer Match"), "UEFA Europa League": ("Soccer", "Soccer Match"), "Formula 1": ("Motorsport", "Sports Event"),
}

# --- fixed values: categories by keywords of a text, for sources that tell none
GROUP_CATEGORIES: list[tuple[str, list[str]]] = [
    ("Technology", ["hackathon", "hack ", "buildathon", "coding", "code ", "developer", "devops", "kubernetes", "docker", "cloud native", "aws ", "gcp ", "azure ", "python ", "javascript", "react ", "node.js", "typescript", "machine learning", "deep learning", "llm", "generative ai", "data science", "data engineering", "blockchain", "web3", "startup", "saas", "open source", "github", "api "]),
    ("Technology", ["conference", "summit", "congress", "symposium", "expo ", "tech talk", "product launch", "demo day", "innovation"]),
    ("Career", ["meetup", "networking", "happy hour", "mixer", "social hour", "after work", "professional network", "connect & grow"]),
    ("Workshop", ["workshop", "bootcamp", "training course", "masterclass", "class ", "certification", "learn to", "how to "]),
    ("Fitness", ["yoga", "pilates", "meditation", "mindfulness", "wellness", "health & wellness", "mental health"]),
    ("Fitness", ["run ", "running", "marathon", "5k", "10k", "cycling", "bike ride", "fitness", "crossfit", "hiit", "workout", "gym ", "trail", "hike", "hiking", "climb"]),
    ("Music", ["music", "concert", "jazz", "dj set", "live music", "band ", "classical", "symphony", "orchestra", "choir", "open mic", "jam session", "acoustic"]),
    ("Art", ["art ", "gallery", "exhibit", "museum", "photography", "painting", "drawing", "sculpture", "illustration", "design ", "creative"]),
    ("Comedy", ["improv", "comedy", "stand-up", "stand up", "open mic comedy"]),
    ("Food & Drink", ["food", "dinner", "brunch", "tasting", "wine", "beer", "cocktail", "cuisine", "restaurant", "cooking", "baking", "culinary"]),
    ("Gaming", ["board game", "tabletop", "dungeon", "d&d", "role play", "gaming", "video game", "esport", "lan party"]),
    ("Dance", ["dance", "salsa", "tango", "swing ", "bachata", "kizomba", "ballroom", "latin dance", "west coast swing"]),
    ("Literature", ["book club", "reading", "author talk", "literary", "poetry", "writing workshop", "storytelling"]),
    ("Outdoor", ["outdoor", "nature", "park ", "garden", "kayak", "canoe", "paddleboard", "camping", "birdwatch", "wildlife"]),
    ("Charity", ["charity", "volunteer", "fundrais", "community service", "nonprofit", "give back", "donation"]),
    ("Workshop", ["language exchange", "language learning", "spanish", "french", "english conversation", "japanese", "mandarin"]),
    ("Career", ["career", "job fair", "interview prep", "resume", "linkedin"]),
    ("Career", ["entrepreneur", "business", "startup pitch", "venture", "investor", "founder"]),
]
CALENDAR_CATEGORIES: list[tuple[str, list[str]]] = [
    ("Technology", ["conference", "summit", "congress", "symposium", "expo"]), ("Technology", ["hackathon", "hack", "buildathon"]), ("Networking", ["meetup", "networking", "happy hour", "mixer"]),
    ("Education", ["workshop", "bootcamp", "training", "course", "class"]), ("Music", ["music", "concert", "jazz", "dj", "live"]), ("Art", ["art", "gallery", "exhibit"]),
]
TAG_CATEGORIES: list[tuple[str, list[str]]] = [
    ("Music", ["jazz", "blues", "soul", "r&b"]), ("Music", ["rock", "pop", "indie", "metal", "punk", "hip hop", "rap", "electronic", "techno", "reggae", "latin", "gospel", "country", "folk", "classical", "orchestr"]), ("Comedy", ["comedy", "stand-up", "standup", "improv"]),
    ("Dance", ["dance", "bachata", "salsa", "tango", "ballroom", "swing", "cumbia", "zouk"]), ("Film", ["film", "cinema", "movie", "screening"]), ("Art", ["art", "exhibition", "gallery", "visual"]), ("Festival", ["festival", "fair"]),
]
DESCRIPTION_CATEGORIES: list[tuple[str, list[str]]] = [("Music", ["music", "concert"]), ("Comedy", ["comedy"]), ("Art", ["art"]), ("Dance", ["dance"]), ("Film", ["film"]), ("Food & Drink", ["food"]), ("Technology", ["tech"]), ("Sports", ["sport"]), ("Festival", ["festival"])]

# --- fixed values: priority of sources when duplicates are merged; others have 1
SOURCE_PRIORITY: dict[str, int] = {"ticketmaster": 10, "resident_advisor": 9, "bandsintown": 8, "scraper": 5, "venue_web": 3}
