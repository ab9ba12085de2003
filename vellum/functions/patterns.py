"""Pattern and word lists of the cleaning and gating operators."""

from __future__ import annotations

#: Marks that scanners leave, counted as artefacts.
OCR_ARTIFACTS = (
    r"[■□▪▫●○◆◇★☆♦♣♠♥]+",
    r"[\^~`]{2,}",
    r"[|!]{3,}",
    r"\.{5,}",
    r"\*{5,}",
    r"_{5,}",
    r"-{5,}",
    r"[^\x00-\x7F]{5,}",
    r"[A-Z\s]{50,}",
)

#: Multi-line notices of scanned books.
SCAN_BLOCKS = (
    r"Google's\s+mission\s+is\s+to\s+organize\s+the\s+world's\s+information.*?(?:Google\s+Book\s+Search|search\s+engine).*?\n",
    r"This\s+is\s+a\s+digital\s+copy\s+of\s+a\s+book\s+that\s+was\s+preserved.*?(?:books\.google\.com|public\s+domain|Google\s+Book\s+Search).*?\n",
    r"About\s+Google\s+Book\s+Search.*?(?:books\.google\.com|Book\s+Search).*?\n",
    r"(?:Whether\s+a\s+book\s+is\s+in\s+the\s+public\s+domain|public\s+domain\s+in\s+the\s+United\s+States).*?Google.*?\n",
    r"(?:We\s+encourage\s+the\s+use\s+of\s+public\s+domain|Usage\s+guidelines|Please\s+do\s+not\s+remove\s+this).*?Google.*?\n",
    r"(?:Maintain\s+attribution|Do\s+not\s+assume).*?(?:Google|public\s+domain).*?\n",
)

#: Mangled forms of the scanner's name, from the start of a line.
MANGLED_NAMES = (
    r"^[^\n]{0,30}[Gg]\s*[Oo0]\s*[Oo0]\s*[Gg]\s*[Ll1]\s*[Ee3][^\n]{0,10}$",
    r"^\s*[^a-zA-Z\n]{0,15}[Gg]oogle\s*$",
    r"^\s*[DdLl][^\n]{0,20}[Gg]oogle\s*$",
    r"^\s*.*?igiti[sz]ed.*?[Gg]oogle.*$",
)

#: Substrings that make a line a notice.
NOTICE_WORDS = (
    r"copyright term has expired",
    r"merely their custodians",
    r"we also ask that you",
    r"non-commercial purposes",
    r"keep it legal",
    r"copyright infringement",
    r"discover the world",
    r"search through the full text",
    r"placing technical restrictions",
    r"automated querying",
    r"helping authors and publishers",
    r"reach new audiences",
    r"whether a book is still in copyright",
    r"varies from country to country",
    r"specific use of any specific book",
    r"anywhere in the world",
    r"public domain material",
    r"hosted by",
    r"authorized facsimile",
    r"university microfilms",
    r"microfilm-xerography",
    r"acid-free paper",
    r"ann arbor",
    r"qooqle",
    r"qoogle",
    r"optical character recognition",
    r"large amount of text",
    r"please contact us",
    r"in the custody of the",
    r"university of california",
    r"los angeles",
    r"digitized by",
    r"digital copy of a book",
    r"public domain in the united states",
    r"books.google",
)

#: Library-trust notices.
TRUST_NOTICES = (
    r"HathiTrust\s+Digital\s+Library[^\n]*\n",
    r"Generated\s+.*?HathiTrust[^\n]*\n",
    r"Public\s+Domain\s+.*?Google-digitized[^\n]*\n",
)

#: Library stamps.
LIBRARY_STAMPS = (
    r"(?i)university\s+of\s+\w+\s*[•·]\s*\w+",
    r"(?i)the\s+library\s+of\s+the\s+university",
    r"(?i)(?:bequest|gift)\s+of\s+[A-Z][^\n]{0,50}\n",
    r"(?i)public\s+domain.*?google",
    r"(?i)scanned\s+by\s+[^\n]{0,50}\n",
    r"(?i)from\s+the\s+collections?\s+of[^\n]*\n",
)

#: Stamps at the start of a leading line.
LEADING_STAMPS = (
    r"(?i)^university\s+of",
    r"(?i)^the\s+library",
    r"(?i)^public\s+library",
    r"(?i)^boston\s+public",
    r"(?i)^property\s+of",
    r"(?i)^in\s+the\s+custody",
    r"(?i)^custody\s+o[fr]",
    r"(?i)^n\s+the\s+custody",
    r"(?i)^shelf\s+n",
    r"(?i)^accession",
    r"(?i)^call\s+n",
    r"(?i)^from\s+the\s+collection",
    r"(?i)^gift\s+of",
    r"(?i)^bequest\s+of",
    r"(?i)^presented\s+by",
    r"(?i)^digitized\s+by",
    r"(?i)^scanned\s+by",
    r"(?i)^oxford\s*$",
    r"(?i)^cambridge\s*$",
    r"(?i)^harvard\s*$",
    r"(?i)^yale\s*$",
    r"(?i)^cornell\s*$",
    r"(?i)^in\s+\d{4}\s+with\s+funding",
    r"(?i)^http://",
    r"(?i)^www\.",
    r"(?i)^archive\.org",
    r"(?i)^harvard\s+college",
    r"(?i)^harvard\s+university",
    r"(?i)^godfrey\s+lowell\s+cabot",
    r"(?i)^science\s+library",
    r"(?i)^science\s+center\s+library",
    r"(?i)^library\s+science\s+center",
    r"(?i)^cabot\s+science",
    r"(?i)^transferred\s+to",
    r"(?i)^from\s+the\s+library\s+of",
    r"(?i)^the\s+gift\s+of",
    r"(?i)^from\s+the\s+books\s+in",
    r"(?i)^from\s+the\s+bequest",
    r"(?i)^from\s+the\s+fund\s+of",
    r"(?i)^from\s+the\s+bright",
    r"(?i)^this\s+book\s+was\s+stolen",
    r"(?i)^it\s+was\s+later\s+recovered",
    r"(?i)^widener\s+library",
    r"(?i)^pickman\s+bequest",
    r"(?i)^bright\s+legacy",
    r"(?i)^\(?class\s+of\s+\d{4}",
    r"(?i)^received",
    r"(?i)^exlibris",
    r"(?i)^ex\s*libris",
    r"(?i)^sigill",
    r"(?i)^veri\s*tas",
    r"(?i)^ecclesia",
    r"(?i)^nov[\s:]+angl",
    r"(?i)^hristo",
    r"(?i)^christo",
    r"(?i)^harvardian",
    r"(?i)^academiae",
    r"(?i)^ademiae",
    r"(?i)^ardianae",
    r"(?i)^virginibus",
    r"^[A-Z]{1,4}\s+\d{1,5}[\s.]",
    r"^\d{3,7}\s*$",
    r"(?i)^bodleian",
    r"(?i)^british\s+museum",
    r"(?i)^british\s+library",
    r"(?i)^national\s+library",
    r"(?i)^library\s+of\s+congress",
    r"(?i)^royal\s+library",
    r"(?i)^free\s+library",
    r"(?i)^lending\s+library",
    r"(?i)^circulating\s+library",
    r"(?i)^donated\s+by",
    r"(?i)^purchased\s+by",
    r"(?i)^entered\s+according\s+to\s+act",
)

#: Stamps anywhere in a short leading line.
LEADING_WORDS = (
    r"(?i)\bharvard\b",
    r"(?i)college\s+library",
    r"(?i)university\s+library",
    r"(?i)ve\w{0,2}r?i?\s*[ts]\w?as",
    r"(?i)harvardian",
    r"(?i)academiae",
    r"(?i)sigill\b",
    r"(?i)eccles\w{0,3}\b",
    r"(?i)\bbequest\b",
    r"(?i)\bgift\s+of\b",
    r"(?i)\btransferred\s+to\b",
    r"(?i)\bclass\s+of\s+\d{4}\b",
)

#: Headings at which the content of a book begins.
CONTENT_HEADINGS = (
    r"(?i)^CHAPTER\s+[IVX\d]+",
    r"(?i)^BOOK\s+[IVX\d]+",
    r"(?i)^PART\s+[IVX\d]+",
    r"(?i)^INTRODUCTION\s*$",
    r"(?i)^PREFACE\s*\.?\s*$",
    r"(?i)^CONTENTS\s*$",
    r"(?i)^T\s*H\s*E\s*$",
    r"(?i)^THE\s+PREFACE",
    r"(?i)^TO\s+THE\s+READER",
    r"(?i)^ADVERTISEMENT\s*$",
    r"(?i)^DEDICATION\s*$",
    r"(?i)^PROLOGUE\s*$",
)

#: Terms of later physics, one of which rejects.
TIER_ONE = (
    r"\bphoton(?:s|ic)?\b",
    r"\bisotope(?:s|ic)?\b",
    r"\bproton(?:s)?\b",
    r"\bneutron(?:s)?\b",
    r"\bspacetime\b",
    r"\bspace-time\b",
    r"\bwave\s+function(?:s)?\b",
    r"\buncertainty\s+principle\b",
    r"\bdark\s+matter\b",
    r"\bdark\s+energy\b",
    r"\bevent\s+horizon(?:s)?\b",
    r"\bmass[–-]energy\b",
    r"\btime\s+dilation\b",
    r"\bradioactive\s+decay\b",
    r"einstein'?s?\s+(?:theory|equation|relativity|field)",
    r"theory\s+of\s+(?:special|general)\s+relativity",
    r"e\s*=\s*mc\s*(?:\^|²|2)",
    r"quantum\s+mechanics",
    r"quantum\s+field\s+theory",
    r"quantum\s+electrodynamics",
    r"heisenberg'?s?\s+uncertainty",
    r"schr[öo]dinger'?s?\s+(?:equation|cat|wave)",
    r"bohr\s+(?:model|radius|atom)",
    r"rutherford'?s?\s+(?:model|experiment|scattering)",
    r"planck(?:'s)?\s+(?:constant|law|length|time|mass)",
    r"nuclear\s+(?:fission|fusion|reactor|bomb|weapon|physics|reaction|energy)",
    r"atomic\s+bomb",
    r"big\s+bang(?:\s+theory)?",
    r"expanding\s+universe",
    r"black\s+hole(?:s)?",
    r"particle\s+accelerator(?:s)?",
    r"standard\s+model",
    r"higgs\s+(?:boson|field|particle)",
    r"antimatter",
    r"positron(?:s)?",
    r"quark(?:s)?",
    r"lepton(?:s)?",
    r"fermion(?:s)?",
    r"boson(?:s)?",
)

#: Ambiguous terms, two of which reject.
TIER_TWO = (
    r"\b(?:special|general)\s+relativity\b",
    r"\btheory\s+of\s+relativity\b",
    r"\brelativistic\b",
    r"\bquantum\s+(?:theory|state|field|number|physics|level|effect)\b",
    r"\bquanta?\s+of\s+(?:energy|light|radiation|action)\b",
    r"\bquantum\b(?=.*\b(?:planck|photon|electron|atom)\b)",
    r"\bquantized\b",
    r"\bquantization\b",
    r"\bnuclear\s+(?:force|decay|radiation|spin|magnetic)\b",
    r"\bhalf[- ]life\b(?=.*\b(?:decay|radioactive|isotope|nuclide|uranium|radium)\b)",
    r"\beinstein\b(?=.*\b(?:relativity|photon|photoelectric|brownian)\b)",
    r"\bheisenberg\b(?=.*\b(?:uncertainty|matrix|quantum)\b)",
)

#: Terms that reject a text by themselves.
ALWAYS_REJECT = (
    r"\bphoton(?:s|ic)?\b",
    r"\bpositron(?:s)?\b",
    r"\bneutrino(?:s|o)?\b",
    r"\bmuon(?:s)?\b",
    r"\bgluon(?:s)?\b",
    r"\bmeson(?:s)?\b",
    r"\bfermion(?:s)?\b",
    r"\bkaon(?:s)?\b",
    r"\bpion(?:s)?\b",
    r"\btauon(?:s)?\b",
    r"\bhadron(?:s|ic)?\b",
    r"\bbaryon(?:s|ic)?\b",
    r"\bquantum\s+mechan",
    r"\bquantum\s+field",
    r"\bquantum\s+electrodynamics\b",
    r"\bquantum\s+chromodynamics\b",
    r"\bquantum\s+theory\b",
    r"\bquantum\s+physics\b",
    r"\bquantum\s+state(?:s)?\b",
    r"\bquantum\s+number(?:s)?\b",
    r"\bquantum\s+level(?:s)?\b",
    r"\bquantum\s+effect(?:s)?\b",
    r"\bquantum\s+entangle",
    r"\bquantum\s+superposition\b",
    r"\bquantum\s+tunnell?ing\b",
    r"\bquantum\s+computing\b",
    r"\bquantum\s+computer(?:s)?\b",
    r"\bquantum\s+gravity\b",
    r"\bquantum\s+optics\b",
    r"\bquantum\s+dot(?:s)?\b",
    r"\bquantum\s+well(?:s)?\b",
    r"\bquantum\s+spin\b",
    r"\bquantum\s+decoherence\b",
    r"\bquantum\s+information\b",
    r"\bquantum\s+cryptography\b",
    r"\bquantized\b",
    r"\bquantization\b",
    r"\bquanta\s+of\s+(?:energy|light|radiation|action)\b",
    r"\bwave\s*[\s-]function(?:s)?\b",
    r"\bwavefunction\b",
    r"\buncertainty\s+principle\b",
    r"\bexclusion\s+principle\b",
    r"\bpauli\s+exclusion\b",
    r"\bpauli\s+matrices\b",
    r"\bsuperposition\s+(?:of\s+)?(?:states?|wavefunctions?)\b",
    r"\bwave[- ]?particle\s+duality\b",
    r"\bde\s+broglie\b",
    r"\bcompton\s+(?:scattering|effect|wavelength)\b",
    r"\bdirac\s+(?:equation|delta|notation|spinor|fermion|sea)\b",
    r"\bfeynman\s+(?:diagram|path|integral|propagator|rule)\b",
    r"\bpath\s+integral(?:s)?\b",
    r"\brenormalization\b",
    r"\bcopenhagen\s+interpretation\b",
    r"\bmany[- ]worlds\s+interpretation\b",
    r"\bbell(?:'?s)?\s+(?:inequality|theorem)\b",
    r"\bEPR\s+paradox\b",
    r"\bspin[- ]orbit\s+coupling\b",
    r"\bzero[- ]point\s+energy\b",
    r"\bspacetime\b",
    r"\bspace-time\b",
    r"\bspecial\s+relativity\b",
    r"\bgeneral\s+relativity\b",
    r"\brelativistic\b",
    r"\btime\s+dilation\b",
    r"\blength\s+contraction\b",
    r"\bmass[–-]energy\b",
    r"\be\s*=\s*mc\s*(?:\^|²|2)\b",
    r"\blorentz\s+(?:transformation|contraction|factor|invariance|covariance)\b",
    r"\bminkowski\s+(?:space|metric|diagram|geometry)\b",
    r"\bgravitational\s+(?:wave|lensing|redshift|time\s+dilation)\b",
    r"\bschwarzschild\s+(?:radius|metric|solution|singularity)\b",
    r"\bgeodesic(?:s)?\b(?=.*\b(?:spacetime|relativity|metric|tensor)\b)",
    r"\bframe[- ]dragging\b",
    r"\btwin\s+paradox\b",
    r"\bequivalence\s+principle\b(?=.*\b(?:einstein|gravity|inertial|relativity)\b)",
    r"\beinstein(?:'?s)?\b",
    r"\bphotoelectric\s+effect\b",
    r"\bnuclear\s+(?:fission|fusion|reactor|bomb|weapon|physics|energy|force|decay|radiation|spin|magnetic|power|warhead|fallout|waste|fuel|chain)\b",
    r"\batomic\s+bomb(?:s)?\b",
    r"\batomic\s+energy\b",
    r"\batomic\s+weapon(?:s)?\b",
    r"\batomic\s+pile\b",
    r"\batomic\s+number\b",
    r"\bchain\s+reaction\b(?=.*\b(?:nuclear|fission|uranium|plutonium|reactor)\b)",
    r"\buranium\s+(?:enrichment|fission|bomb|reactor|milling|hexafluoride|centrifuge)\b",
    r"\bplutonium\b",
    r"\btritium\b",
    r"\bdeuterium\b",
    r"\bcyclotron(?:s)?\b",
    r"\bsynchrotron(?:s)?\b",
    r"\bparticle\s+accelerator(?:s)?\b",
    r"\blinear\s+accelerator\b",
    r"\bcollider(?:s)?\b",
    r"\bradioactive\s+decay\b",
    r"\bradioactivity\b",
    r"\bradioactive\s+(?:isotope|material|waste|contamination|fallout|dating|tracer)\b",
    r"\bhalf[- ]life\b(?=.*\b(?:decay|radioactive|isotope|uranium|radium|thorium|carbon)\b)",
    r"\bisotope(?:s|ic)?\b",
    r"\bstandard\s+model\b(?=.*\b(?:particle|physics|quark|lepton|boson|gauge|higgs)\b)",
    r"\bhiggs\s+(?:boson|field|particle|mechanism)\b",
    r"\bantimatter\b",
    r"\bquark(?:s)?\b",
    r"\blepton(?:s)?\b(?=.*\b(?:particle|electron|muon|neutrino|tau|physics|decay|flavor)\b)",
    r"\bboson(?:s)?\b(?=.*\b(?:particle|higgs|gauge|W\b|Z\b|photon|gluon|physics)\b)",
    r"\bgauge\s+(?:theory|invariance|symmetry|boson|field)\b",
    r"\bsymmetry\s+breaking\b",
    r"\bstrong\s+(?:force|interaction|nuclear)\b",
    r"\bweak\s+(?:force|interaction|nuclear)\b(?=.*\b(?:boson|decay|neutrino|parity|particle)\b)",
    r"\belectroweak\b",
    r"\bcolor\s+charge\b",
    r"\bbig\s+bang(?:\s+theory)?\b",
    r"\bexpanding\s+universe\b",
    r"\bcosmic\s+(?:microwave|inflation|background|ray(?:s)?)\b",
    r"\bhubble(?:'?s)?\s+(?:constant|law|telescope|expansion)\b",
    r"\bredshift\b(?=.*\b(?:galaxy|galaxies|universe|cosmolog|hubble|doppler|recession)\b)",
    r"\bdark\s+matter\b(?=.*\b(?:galaxy|universe|cosmolog|particle|gravit|mass|halo|WIMP)\b)",
    r"\bdark\s+energy\b(?=.*\b(?:universe|cosmolog|expansion|accelerat|vacuum)\b)",
    r"\bcosmological\s+constant\b",
    r"\bsteady[- ]state\s+(?:theory|universe|cosmology)\b",
    r"\bolbers(?:'?s)?\s+paradox\b",
    r"\bevent\s+horizon(?:s)?\b",
    r"\bblack\s+hole(?:s)?\b(?=.*\b(?:singularity|event\s+horizon|hawking|gravity|mass|spacetime|relativity|stellar|supermassive|gravitational|accretion|ergosphere)\b)",
    r"\bneutron\s+star(?:s)?\b",
    r"\bpulsar(?:s)?\b",
    r"\bquasar(?:s)?\b",
    r"\bwhite\s+dwarf(?:s)?\b",
    r"\bred\s+giant(?:s)?\b(?=.*\b(?:star|stellar|evolution|main\s+sequence|supergiant)\b)",
    r"\bmain\s+sequence\b",
    r"\bchandrasekhar\b",
    r"\bhawking\s+radiation\b",
    r"\bhertzsprung[- ]russell\b",
    r"\bstellar\s+(?:evolution|nucleosynthesis)\b",
    r"\bsupernova(?:e|s)?\b(?=.*\b(?:type\s+I|remnant|neutron|collapse|nucleosynthesis)\b)",
    r"\bsuperconduct(?:ivity|ing|or(?:s)?)\b",
    r"\bsuperfluid(?:ity)?\b",
    r"\bbose[- ]einstein\s+(?:condensat|statistic)\w*\b",
    r"\bfermi[- ]dirac\b",
    r"\bfermi\s+(?:level|energy|surface|gas|liquid)\b",
    r"\bband\s+gap\b",
    r"\bband\s+structure\b(?=.*\b(?:electron|solid|crystal|semiconductor|metal)\b)",
    r"\bphonon(?:s)?\b",
    r"\bplasmon(?:s)?\b",
    r"\bexciton(?:s)?\b",
    r"\bmagnon(?:s)?\b",
    r"\blaser(?:s)?\b",
    r"\btransistor(?:s)?\b",
    r"\bsemiconductor(?:s)?\b",
    r"\bintegrated\s+circuit(?:s)?\b",
    r"\bmicroprocessor(?:s)?\b",
    r"\bnuclear\s+(?:power\s+plant|submarine|aircraft\s+carrier)\b",
    r"\bgeiger\s+counter\b",
    r"\bcloud\s+chamber\b",
    r"\bbubble\s+chamber\b",
    r"\belectron\s+microscop(?:e|y)\b",
    r"\bmass\s+spectromet(?:er|ry)\b",
    r"\bnuclear\s+magnetic\s+resonance\b",
    r"\b(?:NMR|MRI)\b",
    r"\bradar\b",
    r"\bsonar\b",
    r"\batomic\s+clock\b",
    r"\bcarbon[- ](?:14|fourteen)\s+dating\b",
    r"\bschr[öo]dinger(?:'?s)?\b",
    r"\bheisenberg(?:'?s)?\b",
    r"\boppenheimer(?:'?s)?\b",
    r"\bfeynman(?:'?s)?\b",
    r"\bbohr(?:'?s)?\s+(?:model|radius|atom|magneton|theory|postulate)\b",
    r"\bplanck(?:'?s)?\s+(?:constant|law|length|time|mass|scale|epoch|radiation|formula)\b",
    r"\brutherford(?:'?s)?\s+(?:model|experiment|scattering|atom|gold\s+foil)\b",
    r"\bdirac(?:'?s)?\b(?=.*\b(?:equation|delta|fermion|sea|spinor|notation|bracket|hole)\b)",
    r"\bpauli(?:'?s)?\b(?=.*\b(?:exclusion|principle|matrices|spin|equation)\b)",
    r"\bfermi(?:'?s)?\b(?=.*\b(?:level|energy|surface|gas|statistics|interaction|paradox|golden)\b)",
    r"\bborn(?:'?s)?\s+(?:approximation|rule|interpretation)\b",
    r"\bsommerfeld\b(?=.*\b(?:model|expansion|constant|quantum)\b)",
    r"\bgamow\b",
    r"\blema[iî]tre\b",
    r"\bhubble\b(?=.*\b(?:telescope|constant|law|expansion|redshift)\b)",
    r"\bproton(?:s)?\b(?=.*\b(?:electron|neutron|nucleus|particle|charge|mass|accelerat|collid|beam|decay|spin|antiproton)\b)",
    r"\bneutron(?:s)?\b(?=.*\b(?:proton|electron|nucleus|particle|fission|reactor|bomb|star|decay|mass|capture|scattering)\b)",
    r"\belectron\s+(?:spin|orbital|shell|cloud|beam|microscop|volt|capture|configuration|diffraction|density|affinity|gun|pair)\b",
    r"\belectron[- ]positron\b",
    r"\bfree\s+electron\b(?=.*\b(?:laser|gas|metal|Fermi|band|Drude)\b)",
    r"\bstring\s+theory\b",
    r"\bsupersymmetry\b",
    r"\bsuperstring\b",
    r"\bM[- ]theory\b",
    r"\bextra\s+dimensions?\b(?=.*\b(?:string|compact|Kaluza|Klein|brane)\b)",
    r"\bbrane\b(?=.*\b(?:string|dimension|bulk|theory)\b)",
    r"\bloop\s+quantum\s+gravity\b",
    r"\bmanhattan\s+project\b",
    r"\blos\s+alamos\b(?=.*\b(?:nuclear|bomb|laboratory|weapon|test)\b)",
    r"\boak\s+ridge\b(?=.*\b(?:nuclear|uranium|reactor|laboratory|national)\b)",
    r"\b(?:CERN|Fermilab|SLAC|DESY|KEK|Brookhaven)\b",
    r"\blarge\s+hadron\s+collider\b",
    r"\batomic\s+energy\s+commission\b",
)

#: Ambiguous terms, three of which reject.
CONTEXT_TERMS = (
    r"\bquantum\b",
    r"\bnuclear\b",
    r"\bblack\s+hole(?:s)?\b",
    r"\bdark\s+matter\b",
    r"\bdark\s+energy\b",
    r"\bfusion\b",
    r"\bfission\b",
    r"\bradiation\b",
    r"\bspectrum\b",
    r"\belectron(?:s)?\b",
)

#: References to later times or to the making of the data.
META_REFERENCES = (
    r"\bartificial\s+intelligence\b",
    r"\blanguage\s+model\b",
    r"\bmachine\s+learning\b",
    r"\bdeep\s+learning\b",
    r"\bneural\s+network\b",
    r"\bcomputer(?:s)?\b",
    r"\binternet\b",
    r"\bemail\b",
    r"\bwebsite\b",
    r"\bonline\b",
    r"\bdigital\b",
    r"\bsoftware\b",
    r"\bhardware\b",
    r"\balgorithm(?:s)?\b",
    r"\bdatabase\b",
    r"\bprogramming\b",
    r"\b(?:AI|ML|NLP|GPT|LLM)\b",
    r"\bchatbot\b",
    r"\bvirtual\s+assistant\b",
    r"\bas\s+an?\s+(?:AI|language\s+model|assistant\s+trained)\b",
    r"\bI\s+(?:was|am)\s+(?:trained|programmed|designed)\b",
    r"\baccording\s+to\s+(?:the\s+)?(?:text|passage|excerpt|source)\b",
    r"\bthe\s+(?:text|passage|excerpt)\s+(?:says|states|mentions|describes|indicates)\b",
    r"\bin\s+the\s+(?:provided|given)\s+(?:text|passage|excerpt)\b",
)

#: Years in which things named by terms of ALWAYS_REJECT were first known, by the beginning of the term.
KNOWN_SINCE = {
    r"\bradioactivity\b": 1898, r"\bquantum\s+theory\b": 1900, r"\bquanta\s+of": 1900, r"\bplanck": 1900, r"\bradioactive\s+decay\b": 1902,
    r"\bspecial\s+relativity\b": 1905, r"\brelativistic\b": 1905, r"\btime\s+dilation\b": 1905, r"\blength\s+contraction\b": 1905, r"\bmass[–-]energy\b": 1905,
    r"\be\s*=\s*mc": 1905, r"\blorentz": 1905, r"\beinstein": 1905, r"\bphotoelectric": 1905, r"\bsonar\b": 1906, r"\bhalf[- ]life": 1907, r"\bspacetime\b": 1908,
    r"\bspace-time\b": 1908, r"\bminkowski": 1908, r"\bgeiger": 1908, r"\bmain\s+sequence": 1911, r"\bhertzsprung": 1911, r"\bsuperconduct": 1911,
    r"\bcloud\s+chamber": 1911, r"\brutherford": 1911, r"\batomic\s+number\b": 1913, r"\bisotope": 1913, r"\bbohr": 1913, r"\bsommerfeld": 1914,
}
#: A term that a later cutoff narrows, and what it becomes.
NARROWED = (1914, r"\bradioactive\s+(?:isotope|material|waste|contamination|fallout|dating|tracer)\b", r"\bradioactive\s+(?:waste|contamination|fallout|dating|tracer)\b")


def terms_after(cutoff: int) -> tuple[str, ...]:
    """The terms of ALWAYS_REJECT for things not yet known in the year ``cutoff``."""
    known = tuple(k for k, year in KNOWN_SINCE.items() if year <= cutoff)
    since, wide, narrow = NARROWED
    return tuple(narrow if cutoff >= since and t == wide else t for t in ALWAYS_REJECT if not t.startswith(known or ("\0",)))


#: The compact list for problems with solutions and answers, matched without regard to case.
COMPACT_REJECT = (
    r"\bphoton(?:s|ic)?\b",
    r"\bpositron(?:s)?\b",
    r"\bneutrino(?:s|o)?\b",
    r"\bmuon(?:s)?\b",
    r"\bgluon(?:s)?\b",
    r"\bmeson(?:s)?\b",
    r"\bfermion(?:s)?\b",
    r"\bboson(?:s)?\b",
    r"\bhadron(?:s|ic)?\b",
    r"\bbaryon(?:s|ic)?\b",
    r"\bquantum\b",
    r"\bquantized\b",
    r"\bquantization\b",
    r"\bwave\s*[\s-]?function(?:s)?\b",
    r"\bwavefunction\b",
    r"\buncertainty\s+principle\b",
    r"\bexclusion\s+principle\b",
    r"\bpauli\b",
    r"\bde\s+broglie\b",
    r"\bcompton\s+(?:scattering|effect|wavelength)\b",
    r"\bdirac\b",
    r"\bfeynman\b",
    r"\bpath\s+integral\b",
    r"\bspin[- ]orbit\s+coupling\b",
    r"\bzero[- ]point\s+energy\b",
    r"\bplanck(?:'?s)?\s+(?:constant|law|distribution|spectrum|radiation|formula)\b",
    r"\b[Ss]-wave\b",
    r"\bspin\s+\$?\s*1/2\b",
    r"\bspin\s+\$?\s*\d+/\d+\b",
    r"\bspin\s+(?:up|down)\b",
    r"\bspins\b",
    r"\belectron(?:s)?\b",
    r"\bfree\s+electron(?:s)?\b",
    r"\bspacetime\b",
    r"\bspace-time\b",
    r"\bspecial\s+relativity\b",
    r"\bgeneral\s+relativity\b",
    r"\brelativistic\b",
    r"\btime\s+dilation\b",
    r"\blength\s+contraction\b",
    r"\bmass[–-]energy\b",
    r"\be\s*=\s*mc\s*(?:\^|²|2)\b",
    r"\blorentz\s+(?:transformation|contraction|factor|invariance|covariance)\b",
    r"\bminkowski\b",
    r"\beinstein(?:'?s)?\b",
    r"\bphotoelectric\s+effect\b",
    r"\brest\s+(?:energy|mass)\b",
    r"m_\{?0\}?",
    r"\\gamma\s*[\^{]",
    r"\bgravitational\s+red\s*shift\b",
    r"\b[Rr]iemannian\b",
    r"g_\{?[0-3][0-3]\}?",
    r"\bspace\s+travele?r\b",
    r"\bnuclear\b",
    r"\batomic\s+number\b",
    r"\bisotope(?:s|ic)?\b",
    r"\bradioactive\b",
    r"\bhalf[- ]life\b",
    r"\bfission\b",
    r"\bfusion\b(?=.*\b(?:nuclear|reactor|plasma|thermonuclear)\b)",
    r"\bcosmic\s+ray(?:s)?\b",
    r"\bproton(?:s)?\b",
    r"\bsuperconduct(?:ivity|ing|or)\b",
    r"\bsuperfluid\b",
    r"\bbose[- ]einstein\b",
    r"\bfermi[- ]dirac\b",
    r"\bfermi\s+(?:level|energy|surface|gas)\b",
    r"\bband\s+gap\b",
    r"\bphonon(?:s)?\b",
    r"\bplasmon(?:s)?\b",
    r"\bexciton(?:s)?\b",
    r"\blaser(?:s)?\b",
    r"\btransistor(?:s)?\b",
    r"\bsemiconductor(?:s)?\b",
    r"\bLED\b",
    r"\bwaveguide(?:s)?\b",
    r"\bantenna(?:e|s)?\b",
    r"\bradar\b",
    r"\bspace\s+(?:telescope|shuttle|station)\b",
    r"\bschr[öo]dinger\b",
    r"\bheisenberg\b",
    r"\bbohr(?:'?s)?\s+(?:model|radius|atom|magneton)\b",
    r"\brutherford(?:'?s)?\s+(?:model|scattering)\b",
    r"\bbig\s+bang\b",
    r"\bdark\s+matter\b",
    r"\bdark\s+energy\b",
    r"\bblack\s+hole\b",
    r"\bneutron\s+star\b",
    r"\bdebye\b",
)

#: Marks of prediction and of opinion in answers.
PREDICTIONS = (
    "coming century shall", "mark my words", "within fifty years", "beyond our present imagining", "annihilated distance", "i predict that by", "i foresee",
    "the twentieth century shall",
)
OPINIONS = ("i hold it to be", "i am firmly convinced", "i am quite convinced", "i am persuaded")

#: Topics kept for evaluation.
EVAL_TOPICS = (
    "blackbody", "black body", "black-body", "ultraviolet catastrophe", "uv catastrophe", "cavity radiation", "spectral energy density", "rayleigh-jeans", "equipartition",
    "photoelectric", "photo-electric", "electrons ejected by light", "chasing a light beam", "frozen light", "light wave stationary", "approaching the speed of light", "speed limit",
    "train and lightning", "train lightning", "simultaneity", "michelson-morley", "michelson morley", "aether wind", "interferometer", "accelerating elevator", "elevator light",
    "elevator in space", "free fall equivalence", "equivalence principle", "falling freely", "weightlessness in free fall",
)

#: Signs of a modern reprint, subjects off the topic, and weights of words on the topic.
REPRINTS = (
    "nabu press", "forgotten books", "kessinger", "createspace", "independently published", "wentworth press", "palala press", "scholar's choice", "scholars choice", "hardpress",
    "rarebooksclub", "general books", "bibliobazaar", "bibliolife", "amazon", "print on demand", "facsimile", "reprint", "leopold classic", "sagwan press", "trieste publishing",
    "andesite press", "franklin classics", "arkose press", "hansebooks",
)
OFF_TOPIC = (
    "fiction", "novel", "poetry", "drama", "plays", "religion", "theology", "bible", "sermons", "philosophy of mind", "political science", "economics", "law", "jurisprudence",
    "medicine", "surgery", "anatomy", "physiology", "botany", "zoology", "biology", "chemistry", "agriculture", "cookery", "cooking", "music theory", "art", "architecture", "history of",
)
ON_TOPIC = {
    "physics": 3, "electricity": 3, "magnetism": 3, "electromagnetic": 3, "electromagnetism": 3, "optics": 3, "optical": 2, "mechanics": 3, "thermodynamics": 3,
    "natural philosophy": 3, "acoustics": 2, "heat": 2, "dynamics": 2, "statics": 2, "hydrostatics": 2, "hydrodynamics": 2, "pneumatics": 2, "gravitation": 3, "gravity": 2,
    "light": 1, "sound": 1, "energy": 1, "force": 1, "motion": 1, "waves": 1, "vibration": 1, "radiation": 2, "spectrum": 2, "spectroscopy": 2, "kinetics": 2, "kinetic theory": 3,
    "galvanic": 2, "voltaic": 2, "telegraph": 1, "telephone": 1, "ether": 2, "aether": 2, "luminiferous": 3, "treatise": 1, "experimental": 1, "mathematical": 1, "lecture": 1,
    "scientific": 1,
}
NOT_TEACHING = (
    "dictionary", "catalog", "catalogue", "newspaper", "gazette", "fiction", "novel", "poetry", "sermon", "hymn", "prayer", "philosophy of mind", "metaphysics", "occult",
    "spiritualism", "astrology", "alchemy", "phrenology", "mesmerism", "political", "law", "jurisprudence", "medical", "surgery", "anatomy", "botany", "zoology", "agriculture",
)

#: Marks of casual and of formal prompts.
CASUAL_MARKS = (
    "hey", "so ", "like,", "like ", "gonna", "kinda", "pretty ", "i'm ", "i've ", "i was ", "what's ", "how's ", "that's ", "don't ", "can't ", "won't ", "isn't ", "didn't ", "cool",
    "stuff", "thing is", "right?", "you know",
)
FORMAL_MARKS = ("esteemed", "good sir", "pray tell", "i beseech", "i have lately", "i have often", "permit me", "most learned", "dear sir", "venerable")
