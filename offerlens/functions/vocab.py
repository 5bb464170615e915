"""Word lists of the shipped wine vocabulary. Every operator takes a ``Vocabulary``; other domains pass their own."""

from __future__ import annotations

from dataclasses import dataclass, field

# Fixed values.
LEGAL = """doc docg dop igt igp aoc aop ao do doca dso vdp vdt qba ava pdo pgi vino vin wein weine wines vini controllata
denominazione origine garantita rotwein weisswein rosewein schaumwein perlwein dessertwein likorwein sussweim susswein sudwein
landwein tafelwein qualitatswein pradikatswein schaumweine stillwein appellation controlee protegee field blend""".split()
PRODUCER = """tenuta tenute azienda aziende agricola agricole cantina cantine societa soc fattoria podere poderi castello marchesi
marchese barone baron conte contessa principe weingut weinkellerei kellerei winzer domaine domaines chateau clos maison cave caves
celler cellers cellier bodega bodegas vinicola vinicole vignobles vignoble vigneti vigneto famille family fils freres gebruder
winery wineries estate estates company co srl spa sa ag gmbh ltd inc sarl scarl eredi casa quinta herdade""".split()
STOP = """de di del della dello delle dei degli da dal das der die den dem le la les el il lo los las the of and e y et und a al
alla au aux in im von vom zu zum d l su con du des dos ai agli alle allo sul sui aus ein eine einer sowie od oder or""".split()
PACKAGING = """flasche flaschen bouteille bouteilles bottle bottles karton kartons harass kiste caisse tray pack gebinde cl ml dl
lt liter litre magnumflasche stk stuck neu aktion angebot sale rabatt statt nur jetzt trinkreif jahrgang millesime pet tetra dose
bib beutel pouch glas schraubverschluss kunststoff einweg mehrweg""".split()
DISCRIMINATING = """especial special speciale seleccion seleccionada limitada limitata edicion edizione singolare vendimia tardia
vendemmia tardiva ice muffato botrytis moelleux liquoreux classico classica riserva riserve reserva reserve gran grande selezione
superiore superieur cru premier grand 1er bourgeois villages vieilles vignes alte reben vecchio vecchie antico sur lie lies kabinett
spatlese auslese beerenauslese trockenbeerenauslese eiswein strohwein hochgewachs grosses erstes gewachs brut extra sec demi dolce
amabile dulce trocken halbtrocken lieblich sussreserve millesimato saten rose rosato rosado blush novello nouveau vintage tawny lbv
crusted garrafeira barrique barricato oak unfiltered unfiltriert naturale passito appassimento ripasso amarone recioto solera
sinusoidal""".split()
RED_TOKENS = """rosso rossi rouge rouges tinto tintos tinta tintas red reds rot roter rote roten noir noirs nero neri negro
negros""".split()
WHITE_TOKENS = """bianco bianchi bianca bianche blanco blancos blanca blancas blanc blancs blanche blanches white whites weiss
weisser weisse weissen branco brancos branca brancas""".split()
GRAPES = """cabernet sauvignon merlot syrah shiraz grenache garnacha tempranillo sangiovese nebbiolo barbera dolcetto montepulciano
primitivo zinfandel aglianico nerello mascalese corvina rondinella molinara lagrein teroldego refosco schiava pinot noir nero gris
grigio bianco meunier chardonnay riesling silvaner sylvaner gewurztraminer traminer muller thurgau kerner scheurebe elbling
chasselas fendant gutedel viognier marsanne roussanne vermentino verdicchio vernaccia trebbiano garganega glera cortese arneis
falanghina fiano greco grillo catarratto inzolia carricante malvasia moscato muscat muskateller albarino verdejo godello mencia
monastrell mourvedre carignan cinsault carmenere malbec bonarda torrontes tannat petit verdot franc blaufrankisch lemberger
zweigelt portugieser trollinger spatburgunder dornfelder regent gamay gamaret garanoir humagne cornalin petite arvine amigne heida
paien completer raeuschling rauschling steen chenin colombard semillon palomino pedro ximenez airen macabeo parellada xarello
loureiro alvarinho touriga nacional franca roriz barroca castelao baga encruzado assyrtiko agiorgitiko xinomavro moschofilero
savatiano furmint harslevelu feteasca saperavi rkatsiteli graciano mazuelo bobal prieto picudo trepat sumoll nerodavola perricone
frappato nascetta timorasso ruche brachetto freisa grignolino pelaverga erbaluce favorita""".split()
COUNTRIES = """spanien espagne espana spain italien italie italia italy frankreich france francia schweiz suisse svizzera
switzerland osterreich autriche austria portugal deutschland allemagne germany chile chili argentinien argentine argentina
australien australie australia sudafrika afrique usa kalifornien californie neuseeland nouvelle zelande griechenland grece ungarn
hongrie""".split()
REGION_WORDS = """cotes cote italia italien italy france frankreich spanien spain espana portugal deutschland germany osterreich
austria schweiz suisse svizzera switzerland chile argentina argentinien australia australien sudafrika africa california
kalifornien usa neuseeland zealand griechenland greece toscana tuscany toskana piemonte piedmont veneto sicilia sizilien sicily
puglia apulien umbria umbrien abruzzo marche lazio campania sardegna sardinien trentino alto adige sudtirol friuli lombardia
liguria emilia romagna molise basilicata calabria bolgheri maremma chianti montalcino montepulciano valpolicella soave prosecco
asti langhe roero monferrato gavi bordeaux bourgogne burgund burgundy rhone loire alsace elsass champagne provence languedoc
roussillon beaujolais chablis medoc graves sauternes pomerol saint emilion margaux pauillac julien estephe rioja ribera duero
priorat navarra rueda penedes
somontano toro jumilla carinena valencia mancha douro alentejo dao vinho verde mosel rheingau pfalz rheinhessen baden franken nahe wachau
burgenland wagram kamptal kremstal steiermark valais wallis vaud waadt geneve genf ticino tessin neuchatel bundner herrschaft graubunden aargau zurich schaffhausen thurgau illes balears baleares
mallorca katalonien catalunya valdobbiadene conegliano treviso verona etna vesuvio colli castelli romani salento manduria primitivo salice
mendoza maipo colchagua casablanca rapel barossa coonawarra mclaren hunter marlborough stellenbosch paarl napa sonoma paso
robles willamette""".split()
COMPOUND_COLOURS = {
    "rose": ["rosewein", "vin rose", "vino rosado", "rose wine"],
    "weiss": ["weisswein", "vin blanc", "vino blanco", "vinho branco", "white wine"],
    "rot": ["rotwein", "vin rouge", "vino tinto", "vinho tinto", "red wine"],
}
CRITIC_NAMES = ["parker", "falstaff", "suckling", "decanter", "vinum", "spectator", "wine spectator", "gaultmillau", "gault millau", "penin",
                "atkin", "dunnuck", "galloni", "vinous", "wine advocate", "advocate", "enthusiast", "veronelli", "gambero"]
QUERY_STYLES = ["vintage", "tawny", "lbv", "crusted", "garrafeira", "blancs", "noirs"]
COUNTRY_LABELS = {
    "spanien": "Spanien", "espagne": "Spanien", "espana": "Spanien", "spain": "Spanien", "italien": "Italien", "italie": "Italien",
    "italia": "Italien", "italy": "Italien", "frankreich": "Frankreich", "france": "Frankreich", "francia": "Frankreich",
    "schweiz": "Schweiz", "suisse": "Schweiz", "svizzera": "Schweiz", "switzerland": "Schweiz", "osterreich": "Österreich",
    "autriche": "Österreich", "austria": "Österreich", "portugal": "Portugal", "deutschland": "Deutschland", "allemagne": "Deutschland",
    "germany": "Deutschland", "chile": "Chile", "chili": "Chile", "argentinien": "Argentinien", "argentine": "Argentinien",
    "argentina": "Argentinien", "australien": "Australien", "australie": "Australien", "australia": "Australien",
    "sudafrika": "Südafrika", "afrique": "Südafrika", "usa": "USA", "kalifornien": "USA", "californie": "USA", "california": "USA",
    "neuseeland": "Neuseeland", "zelande": "Neuseeland", "griechenland": "Griechenland", "grece": "Griechenland", "ungarn": "Ungarn",
    "hongrie": "Ungarn",
}
COUNTRY_BY_REGION = {
    "bordeaux": "Frankreich", "burgund": "Frankreich", "beaujolais": "Frankreich", "chablis": "Frankreich", "cote": "Frankreich",
    "elsass": "Frankreich", "languedoc": "Frankreich", "provence": "Frankreich", "rhone": "Frankreich", "loire": "Frankreich",
    "champagne": "Frankreich", "roussillon": "Frankreich", "sudwest": "Frankreich", "toskana": "Italien", "piemont": "Italien",
    "venetien": "Italien", "friaul": "Italien", "sudtirol": "Italien", "suditalien": "Italien", "sizilien": "Italien",
    "sardinien": "Italien", "umbrien": "Italien", "marken": "Italien", "abruzzen": "Italien", "lombardei": "Italien",
    "trentino": "Italien", "rioja": "Spanien", "ribera": "Spanien", "katalonien": "Spanien", "galicien": "Spanien",
    "priorat": "Spanien", "navarra": "Spanien", "duero": "Spanien", "spanien": "Spanien", "douro": "Portugal",
    "portugal": "Portugal", "alentejo": "Portugal", "wallis": "Schweiz", "waadt": "Schweiz", "genf": "Schweiz", "tessin": "Schweiz",
    "deutschschweiz": "Schweiz", "neuenburg": "Schweiz", "buendner": "Schweiz", "bundner": "Schweiz", "graubunden": "Schweiz",
    "ahr": "Deutschland", "baden": "Deutschland", "pfalz": "Deutschland", "mosel": "Deutschland", "rheingau": "Deutschland",
    "rheinhessen": "Deutschland", "franken": "Deutschland", "nahe": "Deutschland", "wurttemberg": "Deutschland",
    "burgenland": "Österreich", "wachau": "Österreich", "kamptal": "Österreich", "steiermark": "Österreich",
    "niederosterreich": "Österreich", "kremstal": "Österreich", "osterreich": "Österreich", "chile": "Chile",
    "argentinien": "Argentinien", "australien": "Australien", "neuseeland": "Neuseeland", "sudafrika": "Südafrika",
    "kalifornien": "USA", "oregon": "USA", "washington": "USA", "griechenland": "Griechenland", "ungarn": "Ungarn",
}
STYLE_WORDS = {
    "champagner": ["champagne", "champagner", "dom perignon", "krug", "ruinart", "bollinger", "veuve clicquot", "taittinger", "pol roger",
                   "billecart", "deutz", "gosset", "laurent-perrier", "laurent perrier", "moet", "perrier-jouet", "perrier jouet",
                   "piper-heidsieck", "piper heidsieck", "charles heidsieck", "louis roederer", "lanson", "nicolas feuillatte", "drappier",
                   "philipponnat", "jacquart", "ayala", "delamotte", "henriot", "pommery", "canard-duchene", "joseph perrier", "besserat"],
    "schaumwein": ["champagne", "champagner", "prosecco", "cava", "cremant", "sekt", "spumante", "franciacorta", "espumoso", "mousseux",
                   "frizzante", "perlwein", "schaumwein", "valdobbiadene", "cartizze", "asti", "lambrusco", "pet nat"],
    "suesswein": ["sauternes", "barsac", "edelsuss", "beerenauslese", "trockenbeerenauslese", "eiswein", "strohwein", "passito", "recioto",
                  "vin santo", "vinsanto", "tokaji", "tokaj", "porto", "portwein", "madeira", "sherry", "moscatel", "banyuls", "pineau",
                  "dessertwein", "likorwein", "spatlese", "auslese", "monbazillac", "jurancon moelleux"],
    "rose": ["rosewein", "rose", "rosato", "rosado", "blush", "oeil de perdrix", "chiaretto"],
}
RED_WORDS = ["rotwein", "rosso", "rouge", "tinto", "vino rosso", "red wine"]
WHITE_WORDS = ["weisswein", "bianco", "blanc", "blanco", "white wine", "vin blanc"]
RED_NAMES = ["zinfandel", "primitivo", "amarone", "valpolicella", "ripasso", "barolo", "barbaresco", "brunello", "chianti",
             "montepulciano", "aglianico", "nebbiolo", "sangiovese", "barbera", "dolcetto", "negroamaro", "nero d avola", "corvina",
             "cabernet sauvignon", "merlot", "syrah", "shiraz", "malbec", "tempranillo", "garnacha", "monastrell", "mourvedre",
             "carmenere", "petit verdot", "tannat", "zweigelt", "blaufrankisch", "lemberger", "dornfelder", "spatburgunder", "rioja",
             "ribera del duero", "priorat", "bordeaux superieur", "saint-emilion", "pomerol", "medoc", "chateauneuf", "cornas",
             "hermitage", "gigondas"]
WHITE_NAMES = ["chardonnay", "sauvignon blanc", "riesling", "gruner veltliner", "gewurztraminer", "pinot grigio", "pinot gris",
               "verdejo", "albarino", "vermentino", "viognier", "chasselas", "fendant", "muller-thurgau", "silvaner", "soave", "gavi",
               "sancerre", "chablis", "pouilly-fume", "vinho verde", "godello", "arneis", "falanghina", "greco di tufo", "fiano",
               "petite arvine", "sylvaner"]
RED_GRAPES = """merlot syrah shiraz cabernet nebbiolo sangiovese tempranillo primitivo malbec zweigelt blaufrankisch lagrein
aglianico negroamaro grenache carmenere monastrell mourvedre barbera dolcetto corvina pinotage touriga mencia carignan
cinsault""".split()
WHITE_GRAPES = """chardonnay riesling chasselas fendant veltliner verdejo albarino vermentino gewurztraminer silvaner sylvaner
arneis grigio gris viognier semillon chenin colombard godello furmint assyrtiko johannisberg arvine heida completer
marsanne""".split()
STYLE_BY_TYPE = {1: "rot", 2: "weiss", 3: "schaumwein", 4: "rose", 7: "suesswein", 24: "suesswein"}


@dataclass(frozen=True)
class Vocabulary:
    """The lists that text functions and the matcher work with."""

    legal: frozenset[str] = frozenset(LEGAL)
    producer: frozenset[str] = frozenset(PRODUCER)
    stop: frozenset[str] = frozenset(STOP)
    packaging: frozenset[str] = frozenset(PACKAGING)
    discriminating: frozenset[str] = frozenset(DISCRIMINATING)
    colours: tuple[tuple[str, frozenset[str]], ...] = (("rot", frozenset(RED_TOKENS)), ("weiss", frozenset(WHITE_TOKENS)))
    grapes: frozenset[str] = frozenset(GRAPES)
    countries: frozenset[str] = frozenset(COUNTRIES)
    regions: frozenset[str] = frozenset(REGION_WORDS)
    compound_colours: tuple[tuple[str, tuple[str, ...]], ...] = tuple((k, tuple(v)) for k, v in COMPOUND_COLOURS.items())
    critics: tuple[str, ...] = tuple(CRITIC_NAMES)
    query_styles: frozenset[str] = frozenset(QUERY_STYLES)
    extra: dict[str, frozenset[str]] = field(default_factory=dict, hash=False)

    @property
    def colour_tokens(self) -> frozenset[str]:
        return frozenset().union(*(words for _, words in self.colours))

    @property
    def generic(self) -> frozenset[str]:
        """Words that many items share, so that none identifies one."""
        return self.grapes | self.regions | self.colour_tokens | self.discriminating

    def distinctive(self, token: str) -> bool:
        return len(token) > 2 and not token.isdigit() and token not in self.generic


WINE = Vocabulary()
