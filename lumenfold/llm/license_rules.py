"""Signatures of licenses, written by hand, over lower-cased words joined by blanks."""

#: label | name of the license as normalized words (a regular expression) | keywords, one alternative a comma | identifiers
NAMES = r"""
mit | mit(?: expat| x11)? licen[sc]e | mit | mit
mit-0 | mit no attribution | mit attribution | mit 0
apache-1.0 | apache (?:software )?licen[sc]e (?:version |v)?1 0 | apache | apache 1 0
apache-1.1 | apache (?:software )?licen[sc]e (?:version |v)?1 1 | apache | apache 1 1
apache-2.0 | apache (?:software )?licen[sc]e (?:version |v)?2(?: 0)? | apache | apache 2 0
apache | apache (?:software )?licen[sc]e | apache | apache
gpl-1.0 | (?:gnu )?general public licen[sc]e (?:version |v)1(?: 0)? | general public | gpl 1 0(?: only| or later)?
gpl-2.0 | (?:gnu )?general public licen[sc]e (?:version |v)2(?: 0)? | general public | gpl 2 0(?: only| or later)?
gpl-3.0 | (?:gnu )?general public licen[sc]e (?:version |v)3(?: 0)? | general public | gpl 3 0(?: only| or later)?
gpl | (?:gnu )?general public licen[sc]e | general public | gpl
lgpl-2.0 | (?:gnu )?library general public licen[sc]e(?: version 2(?: 0)?)? | library general public | lgpl 2 0(?: only| or later)?
lgpl-2.1 | (?:gnu )?lesser general public licen[sc]e (?:version |v)2 1 | lesser general public | lgpl 2 1(?: only| or later)?
lgpl-3.0 | (?:gnu )?lesser general public licen[sc]e (?:version |v)3(?: 0)? | lesser general public | lgpl 3 0(?: only| or later)?
lgpl | (?:gnu )?lesser general public licen[sc]e | lesser general public | lgpl
agpl-3.0 | (?:gnu )?affero general public licen[sc]e (?:version |v)3(?: 0)? | affero general public | agpl 3 0(?: only| or later)?
agpl | (?:gnu )?affero general public licen[sc]e | affero general public | agpl
gfdl | (?:gnu )?free documentation licen[sc]e | free documentation | gfdl(?: 1 [123])?
bsd-2-clause | (?:simplified bsd|bsd 2 clause|2 clause bsd|freebsd) licen[sc]e | bsd, freebsd | bsd 2 clause
bsd-3-clause | (?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd) licen[sc]e | bsd | bsd 3 clause
bsd-4-clause | (?:original bsd|bsd 4 clause|4 clause bsd) licen[sc]e | bsd | bsd 4 clause
bsd-0-clause | (?:zero clause bsd|bsd zero clause|free public) licen[sc]e | bsd, free public | 0bsd
bsd | bsd(?: style)? licen[sc]e | bsd | bsd
isc | isc licen[sc]e | isc | isc
mpl-1.1 | mozilla public licen[sc]e (?:version |v)?1 1 | mozilla | mpl 1 1
mpl-2.0 | mozilla public licen[sc]e (?:version |v)?2(?: 0)? | mozilla | mpl 2 0
mpl | mozilla public licen[sc]e | mozilla | mpl
epl-1.0 | eclipse public licen[sc]e (?:version |v)?1(?: 0)? | eclipse | epl 1 0
epl-2.0 | eclipse public licen[sc]e (?:version |v)?2(?: 0)? | eclipse | epl 2 0
epl | eclipse public licen[sc]e | eclipse | epl
cddl-1.0 | common development and distribution licen[sc]e(?: (?:version |v)?1 0)? | common development distribution | cddl 1 [01]
cpl-1.0 | common public licen[sc]e(?: (?:version |v)?1 0)? | common public | cpl 1 0
eupl | european union public licen[sc]e(?: (?:version |v)?1 [12])? | european union public | eupl(?: 1 [12])?
artistic-1.0 | artistic licen[sc]e (?:version |v)?1(?: 0)? | artistic | artistic 1 0
artistic-2.0 | artistic licen[sc]e (?:version |v)?2(?: 0)? | artistic | artistic 2 0
artistic | (?:the )?artistic licen[sc]e | artistic | artistic
zlib | zlib(?: libpng)? licen[sc]e | zlib | zlib
libpng | libpng licen[sc]e | libpng | libpng(?: 2 0)?
boost-1.0 | boost software licen[sc]e(?: (?:version |v)?1 0)? | boost | bsl 1 0
busl-1.1 | business source licen[sc]e(?: 1 1)? | business source | busl 1 1
unlicense | (?:the )?unlicense | unlicense | unlicense
wtfpl | do what the f\w* you want to public licen[sc]e | want public | wtfpl
python-2.0 | python software foundation licen[sc]e(?: version 2)? | python foundation | psf 2 0
php-3.01 | php licen[sc]e(?: version 3(?: 01?)?)? | php | php 3 01?
ruby | ruby licen[sc]e | ruby | ruby
perl | same terms as perl(?: itself)? | perl | perl
openssl | openssl licen[sc]e | openssl | openssl
sleepycat | sleepycat (?:public )?licen[sc]e | sleepycat | sleepycat
postgresql | postgresql licen[sc]e | postgresql | postgresql
ofl-1.1 | (?:sil )?open font licen[sc]e(?: version 1 1)? | open font | ofl 1 1
ms-pl | microsoft public licen[sc]e | microsoft | ms pl
ms-rl | microsoft reciprocal licen[sc]e | microsoft | ms rl
ncsa | (?:university of illinois )?ncsa (?:open source )?licen[sc]e | ncsa | ncsa
afl-3.0 | academic free licen[sc]e(?: (?:version |v)?3 0)? | academic | afl 3 0
osl-3.0 | open software licen[sc]e(?: (?:version |v)?3 0)? | open software | osl 3 0
qpl-1.0 | q public licen[sc]e(?: version 1 0)? | q public | qpl 1 0
cecill | cecill(?: [bc])? licen[sc]e | cecill | cecill(?: [12] [01])?
upl-1.0 | universal permissive licen[sc]e(?: version 1 0)? | universal permissive | upl 1 0
mulan-2.0 | mulan permissive software licen[sc]e(?: version 2)? | mulan | mulanpsl 2 0
sspl-1.0 | server side public licen[sc]e(?: version 1)? | server side public | sspl 1 0
elastic-2.0 | elastic licen[sc]e(?: (?:version |v)?2(?: 0)?)? | elastic | elastic 2 0
commons-clause | commons clause(?: licen[sc]e condition)? | commons clause | commons clause
odbl-1.0 | open (?:data commons )?(?:open )?database licen[sc]e | open database | odbl 1 0
odc-by-1.0 | open data commons attribution licen[sc]e | commons attribution | odc by 1 0
pddl-1.0 | public domain dedication and licen[sc]e | domain dedication | pddl 1 0
hippocratic | hippocratic licen[sc]e | hippocratic | hippocratic(?: [23] [01])?
json | json licen[sc]e | json | json
w3c | w3c (?:software (?:notice and )?)?licen[sc]e | w3c | w3c
x11 | x11 licen[sc]e | x11 | x11
vim | vim licen[sc]e | vim | vim
curl | curl licen[sc]e | curl | curl
icu | icu licen[sc]e | icu | icu
""".strip()

#: label | regular expression | keywords: sentences and addresses that tell a license by their wording
WORDINGS = r"""
cc0-1.0 | (?:creative commons )?cc0(?: 1 0)?(?: universal)?(?: public domain dedication)? | cc0
cc-by-1.0 | (?:cc by|creative commons attribution(?: licen[sc]e)?) 1 0 | cc by, creative commons attribution
cc-by-2.0 | (?:cc by|creative commons attribution(?: licen[sc]e)?) 2 [05] | cc by, creative commons attribution
cc-by-3.0 | (?:cc by|creative commons attribution(?: licen[sc]e)?) 3 0 | cc by, creative commons attribution
cc-by-4.0 | (?:cc by|creative commons attribution(?: licen[sc]e)?) 4 0(?: international)? | cc by, creative commons attribution
cc-by-sa-3.0 | (?:cc by sa|creative commons attribution share ?alike) 3 0 | cc by sa, creative commons attribution
cc-by-sa-4.0 | (?:cc by sa|creative commons attribution share ?alike) 4 0(?: international)? | cc by sa, creative commons attribution
cc-by-sa | (?:cc by sa|creative commons attribution share ?alike) | cc by sa, creative commons attribution
cc-by-nd | (?:cc by nd|creative commons attribution no ?deriv(?:ative)?s)(?: [1-4] [05])? | cc by nd, creative commons attribution
cc-by-nc | (?:cc by nc|creative commons attribution non ?commercial)(?: [1-4] [05])? | cc by nc, creative commons attribution
cc-by-nc-sa | (?:cc by nc sa|creative commons attribution non ?commercial share ?alike)(?: [1-4] [05])? | cc by nc sa, creative commons attribution
cc-by-nc-nd | (?:cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative)?s)(?: [1-4] [05])? | cc by nc nd, creative commons attribution
creative-commons | creative commons licen[sc]e | creative commons
cc-by-4.0 | creativecommons org licenses by 4 0 | creativecommons by
cc-by-3.0 | creativecommons org licenses by 3 0 | creativecommons by
cc-by-sa-4.0 | creativecommons org licenses by sa 4 0 | creativecommons by sa
cc-by-sa-3.0 | creativecommons org licenses by sa 3 0 | creativecommons by sa
cc-by-nd | creativecommons org licenses by nd [1-4] [05] | creativecommons by nd
cc-by-nc | creativecommons org licenses by nc [1-4] [05] | creativecommons by nc
cc-by-nc-sa | creativecommons org licenses by nc sa [1-4] [05] | creativecommons by nc sa
cc-by-nc-nd | creativecommons org licenses by nc nd [1-4] [05] | creativecommons by nc nd
cc0-1.0 | creativecommons org publicdomain zero 1 0 | creativecommons publicdomain zero
public-domain | (?:released|placed|dedicated|is) (?:in|into|to) the public domain | public domain
public-domain | public domain dedication | public domain dedication
mit | permission is hereby granted free of charge to any person obtaining a copy of this software | hereby granted charge obtaining
mit | opensource org licenses mit | opensource mit
isc | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted | permission distribute fee hereby
bsd | redistribution and use in source and binary forms with or without modification are permitted | redistribution binary permitted
bsd-3-clause | neither the name of .{1,80}? nor the names of its contributors may be used to endorse | neither endorse contributors
bsd-4-clause | all advertising materials mentioning features or use of this software must display | advertising materials display
bsd-3-clause | opensource org licenses bsd 3 clause | opensource bsd clause
bsd-2-clause | opensource org licenses bsd 2 clause | opensource bsd clause
apache-2.0 | www apache org licenses license 2 0 | apache org licenses
apache-2.0 | you may not use this file except in compliance with the licen[sc]e | compliance except
gpl | www gnu org licenses gpl(?: [123] 0)? | gnu org gpl
lgpl | www gnu org licenses lgpl(?: [23] [01])? | gnu org lgpl
agpl | www gnu org licenses agpl(?: 3 0)? | gnu org agpl
gfdl | www gnu org licenses fdl(?: 1 [123])? | gnu org fdl
gpl-2.0 | gnu org licenses old licenses gpl 2 0 | gnu old gpl
gpl | free software you can redistribute it and or modify it under the terms of the gnu general public | redistribute modify gnu
lgpl | free software you can redistribute it and or modify it under the terms of the gnu lesser general public | redistribute modify lesser
agpl | redistribute it and or modify it under the terms of the gnu affero general public | redistribute modify affero
gpl-2.0-or-later | either version 2 of the licen[sc]e or at your option any later version | version option later
gpl-3.0-or-later | either version 3 of the licen[sc]e or at your option any later version | version option later
gpl-2.0 | gpl ?v2 | gpl, gplv2
gpl-3.0 | gpl ?v3 | gpl, gplv3
lgpl-2.1 | lgpl ?v2 1 | lgpl, lgplv2
lgpl-3.0 | lgpl ?v3 | lgpl, lgplv3
agpl-3.0 | agpl ?v3 | agpl, agplv3
mpl-2.0 | this source code form is subject to the terms of the mozilla public licen[sc]e v 2 0 | mozilla source form
mpl-2.0 | mozilla org mpl 2 0 | mozilla mpl
mpl | mozilla org mpl | mozilla mpl
epl-2.0 | eclipse org legal epl (?:2 0|v20) | eclipse legal
epl-1.0 | eclipse org legal epl v10 | eclipse legal
unlicense | this is free and unencumbered software released into the public domain | unencumbered
unlicense | unlicense org | unlicense org
wtfpl | www wtfpl net | wtfpl net
zlib | this software is provided as is without any express or implied warranty in no event will the authors be held liable | implied warranty authors liable
boost-1.0 | boost org license 1 0 | boost org
boost-1.0 | permission is hereby granted free of charge to any person or organization obtaining a copy of the software | organization obtaining hereby
ofl-1.1 | scripts sil org ofl | sil ofl
cddl-1.0 | opensource org licenses cddl 1 0 | opensource cddl
artistic-2.0 | opensource org licenses artistic 2 0 | opensource artistic
perl | under the same terms as perl itself | perl same terms
openssl | this product includes software developed by the openssl project | openssl product
php-3.01 | this product includes php software | php product includes
json | the software shall be used for good not evil | good evil shall
proprietary | all rights reserved | all rights reserved
proprietary | proprietary and confidential | proprietary confidential
proprietary | (?:may not be|no part of this .{1,40}? may be) (?:reproduced|copied|redistributed) | reproduced, copied, redistributed
proprietary | commercial licen[sc]e | commercial license, commercial licence
free-unspecified | freely (?:distributable|redistributable|available for use) | freely
licensed-unspecified | (?:is |are )?licen[sc]ed under (?:the )?(?:terms of )?(?:the )?[a-z0-9 ]{2,40} | licensed under, licenced under
licensed-unspecified | spdx license identifier [a-z0-9]+(?: [a-z0-9]+)? | spdx identifier
licensed-unspecified | see the (?:file )?(?:license|licence|copying)(?: file| txt| md)? (?:for|file) | see license, see licence, see copying
mit | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software | permission substantial portions
mit | in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract | authors holders contract
mit-0 | to deal in the software without restriction including without limitation .{1,120}? and to permit persons to whom the software is furnished to do so the software is provided | restriction persons furnished provided
x11 | except as contained in this notice the name of .{1,60}? shall not be used in advertising or otherwise to promote the sale | except contained advertising promote
isc | permission to use copy modify and distribute this software (?:and its documentation )?for any purpose (?:and )?with or without fee is hereby granted | permission distribute fee hereby
isc | the software is provided as is and the author disclaims all warranties with regard to this software | author disclaims regard
hpnd | permission to use copy modify and distribute this software and its documentation for any purpose (?:and )?without fee is hereby granted provided that | permission documentation fee provided
hpnd | makes no representations about the suitability of this software for any purpose | representations suitability
bsd-2-clause | redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer | redistributions retain disclaimer
bsd-2-clause | redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer | redistributions reproduce disclaimer
bsd-3-clause | names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission | contributors endorse derived
bsd-3-clause | use of this source code is governed by a bsd style licen[sc]e | governed bsd style
bsd-3-clause-clear | no express or implied licen[sc]es to any party s patent rights are granted by this licen[sc]e | express party patent
bsd-3-clause-lbnl | you are under no obligation whatsoever to provide any bug fixes patches or upgrades | obligation bug patches
bsd-4-clause | this product includes software developed by the university of california berkeley and its contributors | product california berkeley
bsd-1-clause | bsd 1 clause licen[sc]e | bsd clause
bsd-source-code | bsd source code attribution | bsd attribution
0bsd | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided | permission fee hereby provided
apache-2.0 | licen[sc]ed to the apache software foundation asf under one or more contributor licen[sc]e agreements | apache foundation contributor
apache-2.0 | unless required by applicable law or agreed to in writing software distributed under the licen[sc]e is distributed on an as is basis | unless applicable writing basis
apache-2.0 | without warranties or conditions of any kind either express or implied see the licen[sc]e for the specific language governing permissions | warranties kind governing
apache-2.0 | terms and conditions for use reproduction and distribution 1 definitions | reproduction distribution definitions
apache-2.0 | licen[sc]ed under (?:the )?apache 2(?: 0)? | apache 2
apache-1.1 | the names? apache and apache software foundation must not be used to endorse | apache foundation endorse
apache-1.0 | this product includes software developed by the apache group | apache group product
apache-1.1 | this product includes software developed by the apache software foundation | apache foundation product
gpl | this program is free software you can redistribute it and or modify it under the terms of the gnu general public | program redistribute gnu
gpl | you should have received a copy of the gnu general public licen[sc]e along with this program | received gnu along
gpl | write to the free software foundation inc 5[19] (?:temple place|franklin st(?:reet)?) | write foundation
gpl-2.0 | gnu general public licen[sc]e version 2 june 1991 | gnu june 1991
gpl-3.0 | gnu general public licen[sc]e version 3 29 june 2007 | gnu june 2007
gpl-1.0 | gnu general public licen[sc]e version 1 february 1989 | gnu february 1989
gpl | everyone is permitted to copy and distribute verbatim copies of this licen[sc]e document but changing it is not allowed | everyone verbatim changing
gpl | the licen[sc]es for most software are designed to take away your freedom to share and change it | designed freedom share
gpl-3.0 | the gnu general public licen[sc]e is a free copyleft licen[sc]e for software and other kinds of works | copyleft kinds works
gpl-2.0-only | (?:under|of) (?:the )?(?:gnu )?(?:gpl|general public licen[sc]e) (?:version |v)2 only | gpl only, general public only
gpl-3.0-only | (?:under|of) (?:the )?(?:gnu )?(?:gpl|general public licen[sc]e) (?:version |v)3 only | gpl only, general public only
gpl-2.0-or-later | (?:gpl|general public licen[sc]e) (?:version |v)2 or (?:any )?later | gpl later, general public later
gpl-3.0-or-later | (?:gpl|general public licen[sc]e) (?:version |v)3 or (?:any )?later | gpl later, general public later
gpl-2.0 | module licen[sc]e gpl v2 | module gpl v2
gpl | module licen[sc]e gpl | module gpl
gpl-2.0-classpath | linking this library statically or dynamically with other modules is making a combined work based on this library | linking statically combined
gpl-2.0-classpath | classpath exception | classpath exception
gpl-3.0-gcc-exception | gcc runtime library exception | gcc runtime exception
gpl-2.0-bison-exception | as a special exception you may create a larger work that contains part or all of the bison parser skeleton | exception larger bison
gpl-autoconf-exception | if you distribute this file as part of a program that contains a configuration script generated by autoconf | contains script autoconf
gpl-font-exception | font exception | font exception
lgpl | this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public | library redistribute gnu
lgpl | you should have received a copy of the gnu (?:lesser|library) general public licen[sc]e | received gnu general
lgpl-2.1 | gnu lesser general public licen[sc]e version 2 1 february 1999 | lesser february 1999
lgpl-2.0 | gnu library general public licen[sc]e version 2 june 1991 | library june 1991
lgpl-2.1-or-later | either version 2 1 of the licen[sc]e or at your option any later version | version option later
lgpl-2.0 | this is the first released version of the library gpl | first released library
lgpl-3.0 | this version of the gnu lesser general public licen[sc]e incorporates the terms and conditions of version 3 | lesser incorporates conditions
agpl-3.0 | gnu affero general public licen[sc]e version 3 19 november 2007 | affero november 2007
agpl | you should have received a copy of the gnu affero general public licen[sc]e | received affero
agpl | users interacting with it remotely through a computer network | interacting remotely network
gfdl | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[sc]e | permission document documentation
gfdl | with no invariant sections no front cover texts and no back cover texts | invariant cover texts
mpl-1.0 | mozilla public licen[sc]e (?:version |v)?1 0 | mozilla
mpl-1.1 | the contents of this file are subject to the mozilla public licen[sc]e version 1 1 | contents mozilla
mpl-2.0 | if a copy of the mpl was not distributed with this file you can obtain one at | mpl obtain
mpl-2.0 | this source code form is incompatible with secondary licen[sc]es | incompatible secondary
mpl-1.1 | the initial developer of the original code is | initial developer original
npl-1.1 | netscape public licen[sc]e(?: (?:version |v)?1 [01])? | netscape
epl-1.0 | this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e v1 0 | accompanying eclipse
epl-2.0 | this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e (?:v |v)?2 0 | accompanying eclipse
edl-1.0 | eclipse distribution licen[sc]e(?: v ?1 0)? | eclipse distribution
cpl-1.0 | the accompanying program is provided under the terms of this common public licen[sc]e | accompanying common public
ipl-1.0 | ibm public licen[sc]e(?: version 1 0)? | ibm public
cddl-1.1 | common development and distribution licen[sc]e (?:version |v)?1 1 | common development distribution
cddl-1.0 | the contents of this file are subject to the terms of the common development and distribution licen[sc]e | contents development distribution
spl-1.0 | sun public licen[sc]e(?: version 1 0)? | sun public
sissl | sun industry standards source licen[sc]e | sun industry standards
apsl-2.0 | apple public source licen[sc]e(?: (?:version |v)?[12] [0-2])? | apple source
nokia | nokia open source licen[sc]e | nokia open
intel | intel open source licen[sc]e | intel open
intel-simplified | intel simplified software licen[sc]e | intel simplified
rpl-1.5 | reciprocal public licen[sc]e(?: (?:version |v)?1 [15])? | reciprocal public
cpal-1.0 | common public attribution licen[sc]e(?: (?:version |v)?1 0)? | common public attribution
cua-opl-1.0 | cua office public licen[sc]e | cua office
eupl-1.2 | licen[sc]ed under the eupl | eupl
eupl-1.2 | licen[sc]e publique de l union europ[^ ]{1,8}enne | publique union
oclc-2.0 | oclc research public licen[sc]e | oclc research
zpl-2.1 | zope public licen[sc]e(?: zpl)?(?: version 2 [01])? | zope
zlib | this notice may not be removed or altered from any source distribution | notice removed altered
zlib | altered source versions must be plainly marked as such and must not be misrepresented as being the original software | altered plainly misrepresented
zlib | the origin of this software must not be misrepresented you must not claim that you wrote the original software | origin misrepresented claim
libpng | png reference library licen[sc]e | png reference
libtiff | libtiff licen[sc]e | libtiff
ijg | this software is based in part on the work of the independent jpeg group | independent jpeg group
ftl | freetype (?:project )?licen[sc]e | freetype
ftl | portions of this software are copyright .{1,20}? the freetype project | portions freetype project
bzip2 | bzip2 licen[sc]e | bzip2
info-zip | info zip licen[sc]e | info zip
boost-1.0 | distributed under the boost software licen[sc]e | boost software
boost-1.0 | see accompanying file licen[sc]e 1 0 txt | accompanying txt
unlicense | anyone is free to copy modify publish use compile sell or distribute this software | anyone publish compile
unlicense | in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest | jurisdictions dedicate interest
wtfpl | everyone is permitted to copy and distribute verbatim or modified copies of this licen[sc]e document and changing it is allowed | everyone verbatim modified
beerware | beer ?ware licen[sc]e | beerware, beer ware
beerware | if we meet some day and you think this stuff is worth it you can buy me a beer | beer worth
postcardware | postcard ?ware | postcardware, postcard ware
donationware | donation ?ware | donationware, donation ware
shareware | this (?:software|program) is shareware | shareware
freeware | this (?:software|program) is freeware | freeware
python-2.0 | psf licen[sc]e agreement for python | psf agreement python
python-cnri | cnri (?:open source )?(?:gpl compatible )?licen[sc]e agreement | cnri agreement
bitstream-vera | bitstream vera is a trademark of bitstream | bitstream vera trademark
php-3.01 | the name php must not be used to endorse or promote products derived from this software | php endorse promote
ruby | you can redistribute it and or modify it under either the terms of the 2 clause bsdl | redistribute clause bsdl
artistic-1.0-perl | the artistic licen[sc]e which comes with (?:this|the perl) kit | artistic kit
artistic-1.0 | the intent of this document is to state the conditions under which a package may be copied | intent conditions package
artistic-2.0 | this copyright licen[sc]e statement .{0,60}?the artistic licen[sc]e 2 0 | artistic 2
openssl | the names openssl toolkit and openssl project must not be used to endorse | openssl toolkit endorse
ssleay | this product includes cryptographic software written by eric young | cryptographic eric young
ssleay | original ssleay licen[sc]e | ssleay
sleepycat | redistributions in any form must be accompanied by information on how to obtain complete source code | redistributions accompanied complete
postgresql | in no event shall the university of california be liable to any party for direct indirect special incidental | university california liable
ofl-1.1 | this font software is licen[sc]ed under the sil open font licen[sc]e | font sil
ofl-1.1 | reserved font name | reserved font name
ubuntu-font-1.0 | ubuntu font licen[sc]e(?: version 1 0)? | ubuntu font
ms-pl | this licen[sc]e governs use of the accompanying software if you use the software you accept this licen[sc]e | governs accompanying accept
ms-lpl | microsoft limited public licen[sc]e | microsoft limited
ms-eula | microsoft software licen[sc]e terms | microsoft terms
ncsa | to deal with the software without restriction including without limitation the rights to use copy modify | deal restriction limitation
afl-2.1 | academic free licen[sc]e (?:version |v)?[12] [0-2] | academic free
osl-2.1 | open software licen[sc]e (?:version |v)?[12] [01] | open software
ecl-2.0 | educational community licen[sc]e(?: version 2 0)? | educational community
entessa | entessa public licen[sc]e | entessa
fair | usage of the works is permitted provided that this instrument is retained with the works | usage instrument retained
frameworx | frameworx open licen[sc]e | frameworx
lppl-1.3c | latex project public licen[sc]e(?: (?:version |v)?1 [0-3][ac]?)? | latex project
lpl-1.02 | lucent public licen[sc]e(?: version 1 0(?: ?2)?)? | lucent public
miros | miros licen[sc]e | miros
motosoto | motosoto open source licen[sc]e | motosoto
multics | multics licen[sc]e | multics
naumen | naumen public licen[sc]e | naumen
ntp | ntp licen[sc]e | ntp
oset-2.1 | oset (?:foundation )?public licen[sc]e | oset public
sgi-b-2.0 | sgi free software licen[sc]e b | sgi free
simpl-2.0 | simple public licen[sc]e(?: 2 0)? | simple public
vsl-1.0 | vovida software licen[sc]e | vovida
watcom-1.0 | sybase open watcom public licen[sc]e | watcom
xnet | x net licen[sc]e | net license, net licence
blueoak-1.0.0 | blue oak model licen[sc]e(?: 1 0 0)? | blue oak model
parity-7.0 | parity public licen[sc]e(?: 7 0 0)? | parity public
prosperity-3.0 | prosperity public licen[sc]e(?: 3 0 0)? | prosperity public
polyform-noncommercial | polyform noncommercial licen[sc]e(?: 1 0 0)? | polyform noncommercial
polyform-small-business | polyform small business licen[sc]e(?: 1 0 0)? | polyform business
polyform-shield | polyform shield licen[sc]e(?: 1 0 0)? | polyform shield
bsl-change | change date .{1,60}? change licen[sc]e | change date
rail | (?:creativeml )?open rail(?: [ms]{1,2})?(?: licen[sc]e)? | open rail
bigscience-rail | bigscience (?:bloom )?rail(?: 1 0)?(?: licen[sc]e)? | bigscience rail
llama-2 | llama [23](?: [12])? community licen[sc]e(?: agreement)? | llama community
gemma | gemma terms of use | gemma terms
cdla-permissive-2.0 | community data licen[sc]e agreement permissive(?: version)?(?: [12] 0)? | community data permissive
cdla-sharing-1.0 | community data licen[sc]e agreement sharing(?: version)?(?: 1 0)? | community data sharing
odbl-1.0 | open data commons open database licen[sc]e | commons database
odc-by-1.0 | opendatacommons org licenses by | opendatacommons by
odbl-1.0 | opendatacommons org licenses odbl | opendatacommons odbl
pddl-1.0 | opendatacommons org licenses pddl | opendatacommons pddl
ogl-uk-3.0 | open government licen[sc]e (?:version |v)?[123](?: 0)? | open government
ogl-uk | contains public sector information licen[sc]ed under the open government licen[sc]e | sector government
etalab-2.0 | licence ouverte(?: open licence)?(?: version)?(?: 2 0)? | licence ouverte
dl-de-by-2.0 | datenlizenz deutschland namensnennung(?: version)?(?: 2 0)? | datenlizenz namensnennung
dl-de-zero-2.0 | datenlizenz deutschland zero(?: version)?(?: 2 0)? | datenlizenz zero
nlod-2.0 | norwegian licen[sc]e for open government data | norwegian government
cern-ohl-s-2.0 | cern open hardware licen[sc]e version 2 strongly reciprocal | cern hardware strongly
cern-ohl-w-2.0 | cern open hardware licen[sc]e version 2 weakly reciprocal | cern hardware weakly
cern-ohl-p-2.0 | cern open hardware licen[sc]e version 2 permissive | cern hardware permissive
cern-ohl | cern (?:ohl|open hardware licen[sc]e)(?: (?:v|version )?1 [0-2])? | cern ohl, cern hardware
tapr-ohl-1.0 | tapr open hardware licen[sc]e | tapr hardware
solderpad | solderpad hardware licen[sc]e | solderpad
fsf-ap | copying and distribution of this file with or without modification are permitted in any medium without royalty | copying medium royalty
gpl | see the gnu general public licen[sc]e for more details | see gnu details
lgpl | see the gnu lesser general public licen[sc]e for more details | lesser details
cc-by-sa-4.0 | attribution share ?alike 4 0 international | attribution international
cc-by-nc-4.0 | attribution non ?commercial 4 0 international | attribution international
cc-by-nc-sa-4.0 | attribution non ?commercial share ?alike 4 0 international | attribution international
cc-by-nd-4.0 | attribution no ?derivatives 4 0 international | attribution international
cc-by-4.0 | attribution 4 0 international | attribution international
cc-pdm-1.0 | creativecommons org publicdomain mark 1 0 | creativecommons publicdomain mark
cc0-1.0 | to the extent possible under law .{1,60}? has waived all copyright and related or neighboring rights | extent waived neighboring
public-domain | this (?:file|code|software|work) (?:has been put|is hereby put|was placed) in the public domain | public domain
public-domain | the author disclaims copyright to this source code | author disclaims copyright
public-domain-us-gov | work of the united states government | united states government
proprietary | unauthorized (?:copying|reproduction|distribution|use) .{1,60}? (?:is strictly prohibited|is prohibited) | unauthorized prohibited
proprietary | trade secrets? (?:and|or) (?:confidential|proprietary) information | trade information
proprietary | no licen[sc]e (?:express or implied )?is granted | granted
proprietary | end user licen[sc]e agreement | end user agreement
proprietary | for internal use only | internal only
proprietary | non ?disclosure agreement | nondisclosure agreement, disclosure agreement
proprietary | evaluation licen[sc]e | evaluation
""".strip()
