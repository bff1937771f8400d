"""Short public licence notices by family, and sentences that are none."""

#: Notices as their licences recommend them, by family.
TEMPLATES = {
    "mit": [
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
        "SPDX-License-Identifier: MIT",
    ],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Released under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "cc-by": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
        "Licensed under CC BY-SA 4.0.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "all-rights-reserved": [
        "All rights reserved.",
        "Copyright (c) the authors. All rights reserved.",
        "No part of this publication may be reproduced without the prior written permission of the publisher. All rights reserved.",
    ],
}

#: Sentences with some of the notices' words that grant nothing.
OTHERS = [
    "The driver showed a driving license to the officer at the gate.",
    "A fishing license is sold at the office for a small fee.",
    "The general public was free to use the hall without restriction.",
    "Version 2 of the report was released in spring.",
    "The software was free of charge for students.",
    "Copies of the document were associated with the file.",
    "All the rights of the citizens were discussed.",
    "The source of the river is in the mountains.",
    "She was permitted to use the library under the following conditions.",
    "This work is part of a larger project of the foundation.",
    "International terms of trade changed with the new version.",
    "The license plate of the car was noted.",
    "Apache helicopters were seen over the valley.",
    "Students of MIT released a new paper.",
    "The seats are reserved for the public.",
    "A notice in the file said that the program was modified.",
    "Creative people and common sense made the attribution easy.",
    "The publisher reproduced part of the publication.",
    "By the way, the cc of the letter went to the office.",
    "They may redistribute the food later at their option.",
]

#: Other wordings of the families' notices, for calibration only.
REWORDED = {
    "mit": ["Distributed under the MIT license.", "The code is available under the MIT License, see LICENSE."],
    "apache-2.0": ["This package is licensed under the Apache License 2.0.", "Distributed under the terms of the Apache License, Version 2.0."],
    "gpl-3.0": ["Licensed under the GNU General Public License v3.", "This file is part of free software under the GNU General Public License, version 3 or later."],
    "bsd": ["Distributed under the BSD 3-Clause License.", "Licensed under the terms of the BSD license."],
    "mpl-2.0": ["This file is subject to the Mozilla Public License 2.0.", "Distributed under the Mozilla Public License, v. 2.0."],
    "cc-by": ["This text is available under the Creative Commons Attribution 4.0 License.", "Content is licensed under CC BY 4.0."],
    "cc-by-nc": ["Content is licensed under CC BY-NC 4.0.", "Available under the Creative Commons Attribution-NonCommercial 4.0 License."],
    "all-rights-reserved": ["Copyright 2019 the company. All rights reserved.", "All rights are reserved by the publisher. All rights reserved."],
}

#: Notices of licences outside the families, which the unknown class learns.
STRANGERS = [
    "Licensed under the Common Development and Distribution License, version 1.0.",
    "SPDX-License-Identifier: CDDL-1.0",
    "Licensed under the European Union Public Licence, version 1.2.",
    "SPDX-License-Identifier: EUPL-1.2",
    "Distributed under the Boost Software License, Version 1.0.",
    "SPDX-License-Identifier: BSL-1.0",
    "This project is licensed under the terms of the zlib license.",
    "Released under the Artistic License 2.0.",
    "This work is licensed under the Open Data Commons Open Database License, version 1.0.",
    "SPDX-License-Identifier: LGPL-2.1-or-later",
    "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "This work is licensed under the GNU Affero General Public License, version 3.",
    "SPDX-License-Identifier: AGPL-3.0-only",
    "Licensed under the SIL Open Font License, Version 1.1.",
    "Released under the Do What The Fuck You Want To Public License, version 2.",
    "This work is free of known copyright restrictions under the Public Domain Mark 1.0.",
]

#: Notices of still other licences, on which the unknown class is calibrated and which training never sees.
STRANGERS_HELD_OUT = [
    "Licensed under the Eclipse Public License 2.0.",
    "SPDX-License-Identifier: EPL-2.0",
    "This work is dedicated to the public domain under CC0 1.0 Universal.",
    "Licensed under CC0 1.0 Universal.",
    "Released under the ISC License.",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "This is free and unencumbered software released into the public domain.",
    "This project is licensed under the terms of the Microsoft Public License.",
    "Released under the PostgreSQL License.",
]
