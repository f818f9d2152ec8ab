"""Words with their stems as the stemming algorithms' own published samples have them, to compare with what `stemmers` makes.

Typed in, not computed: word and stem by turns. The Hungarian ones were derived by hand from the
description of the algorithm.
"""

from __future__ import annotations

_PAIRS = {
    "en": """consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency consist
        consistent consist consistently consist consisting consist consists consist consolation consol consolations consol consolatory consolatori
        console consol consoled consol consoles consol consolidate consolid consolidated consolid consolidating consolid consoling consol
        consolingly consol consols consol consonant conson consort consort consorted consort consorting consort conspicuous conspicu
        conspicuously conspicu conspiracy conspiraci conspirator conspir conspirators conspir conspire conspir conspired conspir
        conspiring conspir constable constabl constables constabl constance constanc constancy constanc constant constant
        knack knack knackeries knackeri knacks knack knag knag knave knave knaves knave knavish knavish kneaded knead kneading knead
        knee knee kneel kneel kneeled kneel kneeling kneel kneels kneel knees knee knell knell knelt knelt knew knew knick knick knif knif
        knife knife knight knight knightly knight knights knight knit knit knits knit knitted knit knitting knit knives knive knob knob
        knobs knob knock knock knocked knock knocker knocker knockers knocker knocking knock knocks knock knopp knopp knot knot knots knot
        skies sky dying die lying lie tying tie news news inning inning outing outing canning canning herring herring proceed proceed
        exceed exceed succeed succeed happy happi enjoy enjoy flies fli ties tie cries cri by by say say hopping hop hoping hope
        relational relat conditional condit rational ration valency valenc digitizer digit operator oper feudalism feudal decisiveness decis
        hopefulness hope callousness callous formality formal sensitivity sensit sensibility sensibl generate generat generates generat general general
        communication communic arsenal arsenal triplicate triplic formative format formalize formal electricity electr electrical electr
        goodness good revival reviv allowance allow inference infer airliner airlin adjustable adjust defensible defens irritant irrit
        replacement replac adjustment adjust dependent depend adoption adopt homologous homolog effective effect bowdlerize bowdler probate probat rate rate cease ceas""",
    "fr": """continu continu continua continu continuait continu continuant continu continuation continu continue continu continué continu
        continuel continuel continuelle continuel continuellement continuel continuelles continuel continuels continuel continuer continu
        continuera continu continuerait continu continueront continu continuez continu continuité continu continuons continuon
        contorsions contors contour contour contournait contourn contournant contourn contourne contourn contours contour contracta contract
        contracté contract contractée contract contracter contract contractés contract contractions contract contradictoirement contradictoir
        contradictoires contradictoir contraindre contraindr contraint contraint contrainte contraint contraintes contraint contraire contrair
        contraires contrair contraria contrari main main mains main maintenaient mainten maintenait mainten maintenant mainten
        maintenir mainten maintenue maintenu maintien maintien maintint maintint maire mair maires mair mairie mair mais mais maïs maï
        maison maison maisons maison maistre maistr maitre maitr maître maîtr maîtres maîtr maîtresse maîtress maîtresses maîtress
        majesté majest majestueuse majestu majestueusement majestu majestueux majestu majeur majeur majeure majeur major major
        majordome majordom majordomes majordom majorité major majorités major mal mal malacca malacc malade malad malades malad
        maladie malad maladies malad maladive malad""",
    "es": """che che checa chec checar chec checo chec checoslovaquia checoslovaqui chedraoui chedraoui chefs chefs cheliabinsk cheliabinsk chelo chel
        chemical chemical chemicalweek chemicalweek chemise chemis chepo chep cheque chequ chequeo cheque cheques chequ cheraw cheraw
        chesca chesc chester chest chetumal chetumal chetumaleños chetumaleñ chevrolet chevrolet cheyene cheyen cheyenne cheyenn chi chi
        chía chi chiapaneca chiapanec chiapas chiap chiba chib chic chic chica chic chicago chicag chicana chican chicano chican chicas chic
        chicharrones chicharron chichen chich chichimecas chichimec chicles chicl chico chic
        torá tor tórax torax torcer torc toreado tor toreados tor toreándolo tor torear tor toreara tor torearlo tor toreó tore torero torer
        toreros torer torio tori tormenta torment tormentas torment tornado torn tornados torn tornar torn tornen torn torneo torne
        torneos torne tornillo tornill tornillos tornill torniquete torniquet torno torn toro tor toronto toront toros tor torpedearon torped
        torpeza torpez torrado torr torralba torralb torre torr torrencial torrencial torrenciales torrencial torrente torrent
        torreon torreon torreón torreon torres torr torrescano torrescan""",
    "sv": """jakt jakt jaktbössa jaktböss jakten jakt jakthund jakthund jaktkarl jaktkarl jaktkarlar jaktkarl jaktkarlarne jaktkarl
        jaktkarlens jaktkarl jaktlöjtnant jaktlöjtnant jaktlöjtnanten jaktlöjtnant jaktlöjtnantens jaktlöjtnant jalusi jalusi jalusien jalusi
        jalusier jalusi jalusierna jalusi jamaika jamaik jamat jam jamrande jamr jamt jamt jande jand januari januari japanska japansk
        jaquette jaquet jaquettekappa jaquettekapp jargong jargong jasmin jasmin jasminen jasmin jasminer jasmin jasminhäck jasminhäck
        jaspis jaspis jaså jaså javäl javäl jazzvindens jazzvind jcrn jcrn jcsus jcsus je je jemföra jemför jemföras jemför
        jemförelse jemför jemförelser jemför klo klo kloaken kloak klock klock klocka klock klockan klockan klockans klockan klockar klock
        klockare klock klockarens klock klockarne klock klocker klock klockor klock klockorna klock klockornas klock klockors klockor
        klockringning klockringning kloekornas kloek klok klok kloka klok klokare klok klokast klok klokaste klok kloke klok klokhet klok
        klokheten klok klokt klokt kloliknande klolikn klor klor klorna klorn kloroform kloroform kloster klost klostergården klostergård
        klostergårdarna klostergård klosterlik klosterlik klot klot klotrunda klotrund klotrunt klotrunt""",
    "no": """havnedistrikt havnedistrikt havnedistriktene havnedistrikt havnedistrikter havnedistrikt havnedistriktet havnedistrikt
        havnedistriktets havnedistrikt havnedrift havnedrift havnedriften havnedrift havneeffektivitet havneeffektivit havneeier havneei
        havneeiere havneeier havneenheter havneen havneforbund havneforbund havneforbundets havneforbund havneformål havneformål
        havneforvaltningen havneforvaltning havnefunksjonene havnefunksjon havnefunksjoner havnefunksjon havnefylkene havnefylk
        havnefylker havnefylk havnehagen havnehag havneinfrastrukturen havneinfrastruktur havneinnretningene havneinnretning
        havneinnretninger havneinnretning havneinteresser havneinteress havnekapasitet havnekapasit havnekassa havnekass havnekasse havnekass
        havnekassemidler havnekassemidl havnekassen havnekass havnekassene havnekass havnekassens havnekass havnelokalisering havnelokalisering
        havneloven havn havnelovens havn havneløsning havneløsning havneløsningene havneløsning havneløsninger havneløsning
        havnemessig havnemess havnemyndighet havnemynd havnemyndigheten havnemynd havnemyndighetene havnemynd havnemyndigheter havnemynd
        opning opning opninga opning opningsbalanse opningsbalans opningsbalansen opningsbalans opp opp oppad oppad opparbeide opparbeid
        opparbeidede opparbeid opparbeidelse opparbeid opparbeider opparbeid opparbeides opparbeid opparbeidet opparbeid
        opparbeiding opparbeiding oppattbygging oppattbygging oppbevarer oppbevar oppblåst oppblåst oppblåste oppblåst oppbrente oppbrent
        oppbygd oppbygd oppbygde oppbygd oppbygget oppbygg oppbygging oppbygging oppbyggingen oppbygging oppdage oppdag oppdager oppdag
        oppdeling oppdeling oppdelingen oppdeling oppdelt oppdelt oppdrag oppdrag oppdraget oppdrag oppdragsavtale oppdragsavtal""",
    "ru": """в в вавиловка вавиловк вагнера вагнер вагон вагон вагона вагон вагоне вагон вагонов вагон вагоном вагон вагоны вагон важная важн
        важнее важн важнейшие важн важнейшими важн важничал важнича важно важн важного важн важное важн важной важн важном важн важному важн
        важности важност важностию важност важность важност важностью важност важную важн важны важн важные важн важный важн важным важн
        важных важн вазах ваз вазы ваз вакса вакс вакханка вакханк вал вал валандался валанда валентина валентин валериановых валерианов
        валерию валер валетами валет п п па па пава пав павел павел павильон павильон павильонам павильон павла павл павлиний павлин
        павлиньи павлин павлиньим павлин павлович павлович павловна павловн павловне павловн павловной павловн павловну павловн
        павловны павловн павловцы павловц павлыч павлыч павлыча павлыч пагубная пагубн падает пада падай пада падал пада падала пада
        падаль падал падать пада падаю пада падают пада падающего пада падающие пада падеж падеж падение паден падением паден падении паден
        падений паден падения паден паденье паден паденья паден падет падет падут падут падучая падуч падчерицей падчериц падшая падш""",
    "hu": """ház ház házak ház házat ház háznak ház házban ház házból ház házra ház háztól ház házról ház házig ház házként ház
        házzal ház kézzel kéz asztal asztal asztalok asztal asztalt asztal asztalnak asztal asztalra asztal asztalról asztal asztalhoz asztal
        asztalban asztal asztalból asztal asztaltól asztal kert ker kertek kert kertben kert kertből kert kertnek kert kertről kert
        kertet kert ember ember emberek ember embereknek ember emberrel ember emberhez ember virág virág virágok virág virágot virág
        virágnak virág virágban virág virágról virág almák alma almát alm almának alm almában alm kefét kef fának fá madarak madar""",
}
#: language -> (word, stem) pairs.
KNOWN_STEMS: dict[str, list[tuple[str, str]]] = {language: list(zip((words := text.split())[::2], words[1::2])) for language, text in _PAIRS.items()}

#: Sentences in each language, with stop words, accents and signs, beside which the tables have text in four languages only.
SENTENCES: dict[str, tuple[str, ...]] = {
    "en": ("It's the children's house, and they weren't there: 42 rooms_full of café à-la-carte.", "HE said: don't go; I would rather stay at home -- naïve or not!"),
    "es": ("¿Dónde está el niño que cantó la canción más bonita del año pasado?", "Los pingüinos no vuelan; tampoco nadan àquí 3 veces."),
    "fr": ("L'été dernier, nous avons mangé à la mairie avec les élèves de l'école où j'étais.", "Cœur brisé, ça va-t-il mieux? Peut-être; garçon!"),
    "hu": ("A kutya és a macska az asztal alatt ült, mert esett az eső.", "Őszintén szólva nagyon szép idő van ma ÚJRA, ugye? Tűz és víz."),
    "no": ("Jeg er ikke på skolen i dag, men havnedistriktene er åpne for ØRSTA_båt.", "Hun har æren av å være med; vi får se hva de gjør."),
    "ru": ("Это не важно, потому что вагоны и павильоны уже падают.", "Ёлка стояла в углу; мой брат ещё не пришёл — 3 часа!", "Важнейшие слова: в павлиньем падении, ИЛИ нет?"),
    "sv": ("Det är inte klockan som går fel, utan jag som är sen till jakten i år.", "Åsa och Örjan såg älgen på-väg hem; de var så glada_över."),
}
