"""The license signatures: label; priority; keyword; regex.

A regex is matched against words: a blank stands for the border between two
words, and a match begins and ends with whole words.  The keyword is one word of
every match; a rule is tried only on texts that have it.  Priority 3: a license
with its version or full name; 2: a family; 1: a hint.  Later rules of a line's
rank give way to earlier ones.
"""

BASE = """
mit; 3; mit; under the mit license
apache-2; 3; apache; apache license version 2
cc-by-nc; 3; cc; cc by nc
"""

RULES = """
mit; 3; mit; (?:released|licensed|available|distributed|provided|published) under (?:the )?(?:terms of (?:the )?)?mit licen[cs]e
mit; 3; mit; mit expat licen[cs]e
mit; 3; mit; the mit licen[cs]e mit
mit; 3; mit; spdx license identifier mit
mit; 3; permission; permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit; 2; mit; mit licen[cs]ed?
mit; 2; mit; licen[cs]e mit
mit; 2; expat; expat licen[cs]e
mit-0; 3; mit; mit no attribution
mit-0; 3; mit; spdx license identifier mit 0
x11; 3; x11; x11 licen[cs]e
x11; 3; x11; spdx license identifier x11
apache-2; 3; apache; licensed under (?:the )?apache licen[cs]e version 2 0
apache-2; 3; apache; apache licen[cs]e (?:version |v)?2(?: 0)?
apache-2; 3; apache; apache (?:software )?licen[cs]e v?2(?: 0)?
apache-2; 3; apache; spdx license identifier apache 2 0
apache-2; 3; apache; apache org licenses license 2 0
apache-2; 3; apache; apache 2 0
apache-2; 3; asl; asl (?:version )?2(?: 0)?
apache-1.1; 3; apache; apache (?:software )?licen[cs]e (?:version |v)?1 1
apache-1.1; 3; apache; spdx license identifier apache 1 1
apache-1.0; 3; apache; apache (?:software )?licen[cs]e (?:version |v)?1 0
apache; 2; apache; apache (?:software )?licen[cs]ed?
apache; 2; apache; (?:licensed|released|available) under (?:the )?apache
gpl-3; 3; gnu; gnu general public licen[cs]e (?:as published by the free software foundation )?(?:either )?(?:version |v)?3(?: 0)?
gpl-3; 3; gnu; gnu gpl (?:version |v)?3(?: 0)?
gpl-3; 3; gpl; gpl (?:version |v)?3(?: 0)?
gpl-3; 3; gplv3; gplv3
gpl-3; 3; gpl; spdx license identifier gpl 3 0(?: only| or later)?
gpl-3-or-later; 3; gnu; gnu general public licen[cs]e version 3 or (?:at your option )?(?:any )?later(?: version)?
gpl-3-or-later; 3; gpl; gpl 3 0 or later
gpl-2; 3; gnu; gnu general public licen[cs]e (?:as published by the free software foundation )?(?:either )?(?:version |v)?2(?: 0)?
gpl-2; 3; gnu; gnu gpl (?:version |v)?2(?: 0)?
gpl-2; 3; gpl; gpl (?:version |v)?2(?: 0)?
gpl-2; 3; gplv2; gplv2
gpl-2; 3; gpl; spdx license identifier gpl 2 0(?: only| or later)?
gpl-2-or-later; 3; gnu; gnu general public licen[cs]e version 2 or (?:at your option )?(?:any )?later(?: version)?
gpl-2-or-later; 3; gpl; gpl 2 0 or later
gpl-1; 3; gnu; gnu general public licen[cs]e (?:version |v)?1(?: 0)?
gpl; 2; gnu; gnu general public licen[cs]e
gpl; 2; gnu; gnu gpl
gpl; 2; gpl; gpl licen[cs]ed?
gpl; 2; gpl; (?:licensed|released|available|distributed) under (?:the )?(?:terms of (?:the )?)?gpl
gpl; 1; gpl; gpl
lgpl-3; 3; gnu; gnu lesser general public licen[cs]e (?:as published by the free software foundation )?(?:either )?(?:version |v)?3(?: 0)?
lgpl-3; 3; lgpl; lgpl (?:version |v)?3(?: 0)?
lgpl-3; 3; lgplv3; lgplv3
lgpl-2.1; 3; gnu; gnu lesser general public licen[cs]e (?:as published by the free software foundation )?(?:either )?(?:version |v)?2 1
lgpl-2.1; 3; lgpl; lgpl (?:version |v)?2 1
lgpl-2; 3; gnu; gnu library general public licen[cs]e (?:version |v)?2(?: 0)?
lgpl-2; 3; lgpl; lgpl (?:version |v)?2 0
lgpl; 2; lesser; (?:gnu )?lesser general public licen[cs]e
lgpl; 2; library; (?:gnu )?library general public licen[cs]e
lgpl; 2; lgpl; lgpl
agpl-3; 3; affero; (?:gnu )?affero general public licen[cs]e (?:as published by the free software foundation )?(?:either )?(?:version |v)?3(?: 0)?
agpl-3; 3; agpl; agpl (?:version |v)?3(?: 0)?
agpl-3; 3; agplv3; agplv3
agpl-1; 3; affero; affero general public licen[cs]e (?:version |v)?1(?: 0)?
agpl; 2; affero; (?:gnu )?affero general public licen[cs]e
agpl; 2; agpl; agpl
gfdl-1.3; 3; gnu; gnu free documentation licen[cs]e (?:version |v)?1 3
gfdl-1.2; 3; gnu; gnu free documentation licen[cs]e (?:version |v)?1 2
gfdl-1.1; 3; gnu; gnu free documentation licen[cs]e (?:version |v)?1 1
gfdl; 2; documentation; (?:gnu )?free documentation licen[cs]e
gfdl; 2; gfdl; gfdl
bsd-2; 3; bsd; (?:simplified )?bsd 2 clause(?: licen[cs]e)?
bsd-2; 3; bsd; 2 clause bsd(?: licen[cs]e)?
bsd-2; 3; bsd; two clause bsd(?: licen[cs]e)?
bsd-2; 3; freebsd; freebsd licen[cs]e
bsd-2; 3; bsd; simplified bsd licen[cs]e
bsd-3; 3; bsd; bsd 3 clause(?: licen[cs]e)?
bsd-3; 3; bsd; 3 clause bsd(?: licen[cs]e)?
bsd-3; 3; bsd; three clause bsd(?: licen[cs]e)?
bsd-3; 3; bsd; (?:new|modified|revised) bsd licen[cs]e
bsd-3; 3; endorse; neither the name of .{1,120}? may be used to endorse or promote products derived from this software
bsd-4; 3; bsd; bsd 4 clause(?: licen[cs]e)?
bsd-4; 3; bsd; (?:original|old) bsd licen[cs]e
bsd-4; 3; acknowledgement; all advertising materials mentioning features or use of this software must display the following acknowledgement
bsd-0; 3; bsd; (?:zero clause bsd|bsd zero clause)(?: licen[cs]e)?
bsd-0; 3; 0bsd; 0bsd(?: licen[cs]e)?
bsd-0; 3; 0bsd; 0bsd
bsd; 2; redistribution; redistribution and use in source and binary forms with or without modification are permitted
bsd; 2; bsd; bsd (?:style )?licen[cs]ed?
bsd; 2; bsd; under (?:the )?bsd
mpl-2; 3; mozilla; mozilla public licen[cs]e (?:version |v)?2(?: 0)?
mpl-2; 3; mpl; mpl (?:version |v)?2(?: 0)?
mpl-1.1; 3; mozilla; mozilla public licen[cs]e (?:version |v)?1 1
mpl-1.1; 3; mpl; mpl (?:version |v)?1 1
mpl-1; 3; mozilla; mozilla public licen[cs]e (?:version |v)?1 0
mpl; 2; mozilla; mozilla public licen[cs]e
epl-2; 3; eclipse; eclipse public licen[cs]e (?:version |v)?2(?: 0)?
epl-2; 3; epl; epl (?:version |v)?2(?: 0)?
epl-1; 3; eclipse; eclipse public licen[cs]e (?:version |v)?1(?: 0)?
epl-1; 3; epl; epl (?:version |v)?1 0
epl; 2; eclipse; eclipse public licen[cs]e
edl-1; 3; eclipse; eclipse distribution licen[cs]e(?: (?:version |v)?1(?: 0)?)?
eupl-1.2; 3; eupl; eupl (?:version |v)?1 2
eupl-1.1; 3; eupl; eupl (?:version |v)?1 1
eupl; 2; eupl; eupl
eupl; 2; european; european union public licen[cs]e
cddl-1.1; 3; cddl; cddl (?:version |v)?1 1
cddl-1; 3; cddl; cddl (?:version |v)?1 0
cddl; 2; cddl; cddl
cddl; 2; common; common development and distribution licen[cs]e
cpl-1; 3; common; common public licen[cs]e(?: (?:version |v)?1(?: 0)?)?
cpal-1; 3; common; common public attribution licen[cs]e(?: (?:version |v)?1(?: 0)?)?
isc; 3; isc; isc licen[cs]e
isc; 3; isc; spdx license identifier isc
isc; 3; permission; permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
zlib; 3; zlib; zlib licen[cs]e
zlib; 3; zlib; zlib libpng licen[cs]e
zlib; 3; zlib; spdx license identifier zlib
libpng; 3; libpng; libpng licen[cs]e
boost-1; 3; boost; boost software licen[cs]e(?: (?:version |v)?1(?: 0)?)?
boost-1; 3; bsl; spdx license identifier bsl 1 0
unlicense; 3; unlicense; (?:the )?unlicense
unlicense; 3; unencumbered; this is free and unencumbered software released into the public domain
wtfpl; 3; wtfpl; wtfpl
wtfpl; 3; want; do what the f[a-z]+ you want to public licen[cs]e
beerware; 3; beerware; beerware(?: licen[cs]e)?
beerware; 3; beer; beer ware licen[cs]e
artistic-2; 3; artistic; artistic licen[cs]e (?:version |v)?2(?: 0)?
artistic-1; 3; artistic; artistic licen[cs]e (?:version |v)?1(?: 0)?
artistic; 2; artistic; artistic licen[cs]e
perl; 2; perl; same terms as perl(?: itself)?
python-2; 3; python; python (?:software foundation )?licen[cs]e (?:version |v)?2(?: 0)?
python; 2; python; python software foundation licen[cs]e
psf; 2; psf; psf licen[cs]e
php-3.01; 3; php; php licen[cs]e (?:version |v)?3 01
php-3; 3; php; php licen[cs]e (?:version |v)?3(?: 0)?
php; 2; php; php licen[cs]e
ruby; 2; ruby; ruby licen[cs]e
postgresql; 3; postgresql; postgresql licen[cs]e
openssl; 3; openssl; openssl licen[cs]e
openssl; 2; ssleay; ssleay licen[cs]e
openldap; 3; openldap; openldap public licen[cs]e
vim; 3; vim; vim licen[cs]e
icu; 3; icu; icu licen[cs]e
unicode; 3; unicode; unicode (?:inc )?licen[cs]e(?: agreement)?
w3c; 3; w3c; w3c (?:software )?(?:notice and )?licen[cs]e
tcl; 3; tcl; tcl tk licen[cs]e
ofl-1.1; 3; sil; sil open font licen[cs]e(?: (?:version |v)?1 1)?
ofl-1.1; 3; ofl; ofl (?:version |v)?1 1
ofl; 2; font; open font licen[cs]e
ncsa; 3; ncsa; (?:university of illinois )?ncsa open source licen[cs]e
afl-3; 3; academic; academic free licen[cs]e (?:version |v)?3(?: 0)?
afl; 2; academic; academic free licen[cs]e
osl-3; 3; osl; osl (?:version |v)?3(?: 0)?
osl-3; 3; open; open software licen[cs]e (?:version |v)?3(?: 0)?
osl; 2; open; open software licen[cs]e
ms-pl; 3; microsoft; microsoft public licen[cs]e
ms-pl; 3; ms; ms pl
ms-rl; 3; microsoft; microsoft reciprocal licen[cs]e
qpl-1; 3; q; q public licen[cs]e(?: (?:version |v)?1(?: 0)?)?
sleepycat; 3; sleepycat; sleepycat licen[cs]e
sspl-1; 3; sspl; sspl(?: (?:version |v)?1(?: 0)?)?
sspl-1; 3; server; server side public licen[cs]e(?: (?:version |v)?1(?: 0)?)?
busl-1.1; 3; business; business source licen[cs]e(?: (?:version |v)?1 1)?
elastic-2; 3; elastic; elastic licen[cs]e(?: (?:version |v)?2(?: 0)?)?
commons-clause; 3; commons; commons clause(?: licen[cs]e condition)?
polyform; 3; polyform; polyform (?:noncommercial|small business|strict|shield) licen[cs]e(?: 1 0 0)?
upl-1; 3; universal; universal permissive licen[cs]e(?: (?:version |v)?1(?: 0)?)?
ecl-2; 3; educational; educational community licen[cs]e(?: (?:version |v)?2(?: 0)?)?
cecill-2.1; 3; cecill; cecill (?:version |v)?2 1
cecill-b; 3; cecill; cecill b
cecill-c; 3; cecill; cecill c
cecill; 2; cecill; cecill
mulan-2; 3; mulan; mulan (?:psl|permissive software licen[cs]e)(?: v?2)?
cc0-1.0; 3; cc0; cc0(?: 1 0)?(?: universal)?
cc0-1.0; 3; zero; creative commons zero(?: (?:version |v)?1 0)?
cc-by-4.0; 3; cc; cc by 4 0
cc-by-3.0; 3; cc; cc by 3 0
cc-by-2.5; 3; cc; cc by 2 5
cc-by-2.0; 3; cc; cc by 2 0
cc-by-sa-4.0; 3; cc; cc by sa 4 0
cc-by-sa-3.0; 3; cc; cc by sa 3 0
cc-by-sa-2.5; 3; cc; cc by sa 2 5
cc-by-nc-4.0; 3; cc; cc by nc 4 0
cc-by-nc-3.0; 3; cc; cc by nc 3 0
cc-by-nc-2.0; 3; cc; cc by nc 2 0
cc-by-nc-sa-4.0; 3; cc; cc by nc sa 4 0
cc-by-nc-sa-3.0; 3; cc; cc by nc sa 3 0
cc-by-nc-nd-4.0; 3; cc; cc by nc nd 4 0
cc-by-nc-nd-3.0; 3; cc; cc by nc nd 3 0
cc-by-nd-4.0; 3; cc; cc by nd 4 0
cc-by-nd-3.0; 3; cc; cc by nd 3 0
cc-by-nc-sa; 2; cc; cc by nc sa
cc-by-nc-nd; 2; cc; cc by nc nd
cc-by-sa; 2; cc; cc by sa
cc-by-nd; 2; cc; cc by nd
cc-by; 2; cc; cc by
cc-by-nc-sa; 3; creative; creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?(?: international| unported)?(?: licen[cs]e)?
cc-by-nc-nd; 3; creative; creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: [1-4] [05])?(?: international| unported)?(?: licen[cs]e)?
cc-by-nc; 3; creative; creative commons attribution non ?commercial(?: [1-4] [05])?(?: international| unported)?(?: licen[cs]e)?
cc-by-sa; 3; creative; creative commons attribution share ?alike(?: [1-4] [05])?(?: international| unported)?(?: licen[cs]e)?
cc-by-nd; 3; creative; creative commons attribution no ?deriv(?:ative)?s(?: [1-4] [05])?(?: international| unported)?(?: licen[cs]e)?
cc-by; 3; creative; creative commons attribution(?: [1-4] [05])?(?: international| unported)?(?: licen[cs]e)?
cc-by-sa; 3; creativecommons; creativecommons org licenses by sa(?: [1-4] [05])?
cc-by-nc-sa; 3; creativecommons; creativecommons org licenses by nc sa(?: [1-4] [05])?
cc-by-nc-nd; 3; creativecommons; creativecommons org licenses by nc nd(?: [1-4] [05])?
cc-by-nc; 3; creativecommons; creativecommons org licenses by nc(?: [1-4] [05])?
cc-by-nd; 3; creativecommons; creativecommons org licenses by nd(?: [1-4] [05])?
cc-by; 3; creativecommons; creativecommons org licenses by(?: [1-4] [05])?
cc0-1.0; 3; creativecommons; creativecommons org publicdomain zero(?: 1 0)?
creative-commons; 1; creative; creative commons
odbl-1.0; 3; odbl; odbl(?: (?:version |v)?1 0)?
odbl-1.0; 3; database; open database licen[cs]e(?: (?:version |v)?1 0)?
odc-by-1.0; 3; commons; open data commons attribution licen[cs]e(?: (?:version |v)?1 0)?
pddl-1.0; 3; pddl; pddl(?: (?:version |v)?1 0)?
pddl-1.0; 3; dedication; public domain dedication and licen[cs]e
cdla-permissive; 3; cdla; cdla permissive (?:version |v)?[12] 0
cdla-sharing; 3; cdla; cdla sharing (?:version |v)?1 0
ogl-3; 3; government; open government licen[cs]e(?: (?:version |v)?3(?: 0)?)?
public-domain; 2; public; (?:released|placed|dedicated) (?:in|into|to) the public domain
public-domain; 1; public; public domain
openrail; 3; openrail; (?:creativeml )?(?:bigscience )?openrail(?: m)?(?: licen[cs]e)?
openrail; 3; rail; (?:creativeml )?(?:bigscience )?open rail(?: m)?(?: licen[cs]e)?
llama-community; 3; llama; llama (?:[234] )?community licen[cs]e(?: agreement)?
proprietary; 2; rights; all rights reserved
proprietary; 2; confidential; proprietary and confidential
proprietary; 2; redistribute; you may not (?:copy modify or )?redistribute
copyright; 1; copyright; copyright (?:c )?(?:19|20)[0-9][0-9]
license-hint; 1; license; (?:licensed|released|distributed|available) under (?:the )?(?:terms of )?[^ ]+ license
license-hint; 1; terms; see (?:the )?license (?:file )?for (?:the )?terms
"""
